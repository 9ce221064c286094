"""Queries of figure matching, layout and page geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.operators import segment as S
from quire.operators import spatial as P
from quire.plans import sqlbits as B
from quire.session import table as t


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "blocks").drop("ingested_at").distinct()


def img_range(s: SparkSession, d: str) -> DataFrame:
    return P.images_by_range(_blocks(s, d))


def img_nearest(s: SparkSession, d: str) -> DataFrame:
    return P.images_by_nearest(_blocks(s, d))


def img_relink(s: SparkSession, d: str) -> DataFrame:
    return P.relink_images(t(s, d, "page_images"), t(s, d, "blocks"))


def img_orphan(s: SparkSession, d: str) -> DataFrame:
    return P.orphan_images(t(s, d, "page_images"), t(s, d, "blocks"))


def img_fill(s: SparkSession, d: str) -> DataFrame:
    return P.fill_image_paths(_blocks(s, d), t(s, d, "page_images"))


def img_rank(s: SparkSession, d: str) -> DataFrame:
    """Rank and number of the images of each page."""
    from pyspark.sql import Window as W

    i = t(s, d, "page_images").filter("path IS NOT NULL").select("doc_id", "page_idx", "path", "y0").distinct()
    w = W.partitionBy("doc_id", "page_idx")
    return i.select("doc_id", "page_idx", "path", F.row_number().over(w.orderBy("y0", "path")).alias("rank"), F.count("*").over(w).alias("on_page"))


def tiny_image(s: SparkSession, d: str) -> DataFrame:
    return P.real_images(t(s, d, "page_images")).distinct()


def img_warnings(s: SparkSession, d: str) -> DataFrame:
    return P.image_warnings(_blocks(s, d))


def img_embedded(s: SparkSession, d: str) -> DataFrame:
    """Embedded images of all pages as raw blocks."""
    return P.embedded_images(t(s, d, "page_images")).select("doc_id", "page_idx", "col_side", "img_path", F.get("bbox", F.lit(0)).alias("x0"), F.get("bbox", F.lit(3)).alias("y1"))


def img_pages(s: SparkSession, d: str) -> DataFrame:
    return P.figure_pages(t(s, d, "page_images"), _blocks(s, d))


def img_page_map(s: SparkSession, d: str) -> DataFrame:
    """Every question with the number and the first of the images of its page, by a map of its document's pages."""
    q = S.distinct_questions(t(s, d, "questions")).select("question_id", "doc_id", "source_page")
    on = P.paths_on("pages", "source_page")
    return q.join(P.page_map(t(s, d, "page_images")), "doc_id").select("question_id", F.size(on).alias("n_images"), F.get(on, F.lit(0)).alias("first_path"))


def block_centres(s: SparkSession, d: str) -> DataFrame:
    return P.centres(_blocks(s, d)).groupBy("doc_id", "sheet", "side").agg(F.round(F.avg("x_mid"), 4).alias("x_mid"), F.round(F.avg("y_mid"), 4).alias("y_mid"), F.count("*").alias("n"))


def a3_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages of exams that have a right column, taken as sheets of double width, as left and right long pages."""
    p = _blocks(s, d).groupBy("doc_id", "page_idx").agg(F.when(F.max("col_side") == 1, 1190.0).otherwise(595.0).alias("width"))
    return P.split_sheets(p).select("doc_id", "page_idx", "long_page", "mark")


def a3_sides(s: SparkSession, d: str) -> DataFrame:
    return P.infer_sides(t(s, d, "questions").select("doc_id", "q_ord", "q_index").distinct())


def a3_join(s: SparkSession, d: str) -> DataFrame:
    q = t(s, d, "questions").select("doc_id", "q_ord", "q_index", "col_side").distinct()
    return P.join_sides(q.filter("col_side <= 0"), q.filter("col_side = 1"))


def layout_multi(s: SparkSession, d: str) -> DataFrame:
    """Tags of questions by a layout built from their exam's stored flags for its first pages, then by section title."""
    q = S.distinct_questions(t(s, d, "questions"))
    lay = q.filter("is_multi_select IS NOT NULL AND source_page < 5").select("doc_id", F.col("source_page").alias("page_idx"), F.when(F.col("is_multi_select"), "multi").otherwise("single").alias("kind"), F.col("q_index").alias("qnum")).distinct()
    return L.tag_multi_select(q, lay).select("question_id", "multi_tag")


def layout_ranges(s: SparkSession, d: str) -> DataFrame:
    """Ranges announced in the headers of first pages, which are put together from the numbers of their single and multiple questions."""
    q = S.distinct_questions(t(s, d, "questions")).filter("is_multi_select IS NOT NULL AND source_page < 5")
    r = q.groupBy("doc_id", F.col("source_page").alias("page_idx")).agg(*[f(F.when(F.col("is_multi_select") == m, F.col("q_index"))).alias(n) for n, f, m in (("a", F.min, False), ("b", F.max, False), ("c", F.min, True), ("d", F.max, True))])
    text = F.concat_ws("\n", F.lit("注意事项：考试用时 90 分钟，满分 100 分"), F.concat(F.lit("一、单项选择题：第"), "a", F.lit("~"), "b", F.lit("题")), F.concat(F.lit("二、多项选择题："), "c", F.lit(" 至 "), "d", F.lit("题")))
    return L.page_layout(r.select("doc_id", "page_idx", text.alias("text")))


_B = "WITH b AS (SELECT DISTINCT block_id, doc_id, block_ord, q_ord, block_type, content, bbox, page_idx, img_path, col_side, least(bbox[1], bbox[3]) AS x0, greatest(bbox[1], bbox[3]) AS x1, least(bbox[2], bbox[4]) AS y0, greatest(bbox[2], bbox[4]) AS y1 FROM blocks)"
_NAME = lambda c: B.ext(c, "([^/\\\\]*)$", 1)
QUERIES = {f.__name__: f for f in (img_range, img_nearest, img_relink, img_orphan, img_fill, img_rank, tiny_image, img_warnings, img_embedded, img_pages, img_page_map, block_centres, a3_pages, a3_sides, a3_join, layout_multi, layout_ranges)}
ORACLE = {
    "img_range": f"{_B}, p AS (SELECT *, CASE WHEN col_side IN (0, 1) THEN col_side ELSE -1 END AS side, coalesce(y0, (row_number() OVER w - 1)::DOUBLE / count(*) OVER (PARTITION BY doc_id, page_idx, block_type) * 842) AS y FROM b WINDOW w AS (PARTITION BY doc_id, page_idx, block_type ORDER BY block_ord, block_id)),"
    " qy AS (SELECT doc_id, page_idx, side, q_ord AS q, min(y) AS y FROM (SELECT * FROM p WHERE side >= 0 UNION ALL SELECT * REPLACE (-1 AS side) FROM p) WHERE q_ord IS NOT NULL AND block_type <> 'image' GROUP BY ALL), i AS (SELECT * FROM p WHERE block_type = 'image')"
    " SELECT i.block_id, any_value(i.q_ord) AS q_ord, coalesce(arg_max(qy.q, (qy.y, qy.q)) FILTER (WHERE qy.y <= i.y), arg_max(qy.q, (qy.y, qy.q))) AS assigned FROM i LEFT JOIN qy ON i.doc_id = qy.doc_id AND i.page_idx = qy.page_idx AND i.side = qy.side GROUP BY i.block_id",
    "img_nearest": f"{_B}, i AS (SELECT block_id, doc_id, page_idx, q_ord AS own, (y0 + y1) / 2 AS y FROM b WHERE block_type = 'image'), x AS (SELECT doc_id, page_idx, q_ord AS q, y0, y1, coalesce(contains(content, '如图'), false) AS refers FROM b WHERE block_type = 'text' AND q_ord IS NOT NULL)"
    " SELECT i.block_id, any_value(own) AS q_ord, coalesce(arg_min(q, (y0, q)) FILTER (WHERE y0 <= y AND y <= y1), arg_max(q, (y0, q)) FILTER (WHERE y1 < y), any_value(own), min(q) FILTER (WHERE refers)) AS assigned FROM i LEFT JOIN x USING (doc_id, page_idx) GROUP BY i.block_id",
    "img_relink": f"WITH i AS (SELECT DISTINCT doc_id, path FROM page_images WHERE path IS NOT NULL), m AS (SELECT i.*, (SELECT min(block_id) FROM blocks b WHERE b.doc_id = i.doc_id AND b.img_path = i.path) AS ex, (SELECT min(block_id) FROM blocks b WHERE b.doc_id = i.doc_id AND {_NAME('b.img_path')} = {_NAME('i.path')}) AS nm FROM i)"
    " SELECT doc_id, path, coalesce(ex, nm) AS block_id, CASE WHEN ex IS NOT NULL THEN 'exact' WHEN nm IS NOT NULL THEN 'name' ELSE 'orphan' END AS how FROM m",
    "img_orphan": f"SELECT DISTINCT i.doc_id, coalesce(try_cast({B.ext(_NAME('i.path'), 'page[_ -]*([0-9]+)', 1)} AS INTEGER) - 1, i.page_idx) AS page_idx, i.path FROM page_images i WHERE path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = i.doc_id AND {_NAME('b.img_path')} = {_NAME('i.path')})",
    "img_fill": f"{_B}, l AS (SELECT doc_id, page_idx, arg_max(path, (y0, path)) AS last FROM page_images WHERE path IS NOT NULL GROUP BY ALL) SELECT block_id, coalesce(img_path, last) AS img_path FROM b LEFT JOIN l USING (doc_id, page_idx) WHERE block_type = 'image'",
    "img_rank": "SELECT doc_id, page_idx, path, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY y0, path)::INTEGER AS rank, count(*) OVER (PARTITION BY doc_id, page_idx) AS on_page FROM (SELECT DISTINCT doc_id, page_idx, path, y0 FROM page_images WHERE path IS NOT NULL)",
    "tiny_image": "SELECT DISTINCT * FROM page_images WHERE NOT coalesce(abs((x1 - x0) * (y1 - y0)) < 8000, false)",
    "img_warnings": f"{_B}, c AS (SELECT *, coalesce((x0 + x1) / 2, 500) AS x_mid FROM b), q AS (SELECT doc_id, q_ord, page_idx, avg(x_mid) AS qx, bool_or(coalesce(regexp_matches(content, '图|(?i:fig)'), false)) AS mentions FROM c WHERE block_type = 'text' AND q_ord IS NOT NULL GROUP BY ALL)"
    " SELECT * FROM (SELECT block_id, NOT mentions AS no_reference, abs(x_mid - qx) > 200 AS far FROM c JOIN q USING (doc_id, q_ord, page_idx) WHERE block_type = 'image') WHERE no_reference OR far",
    "img_embedded": "SELECT DISTINCT doc_id, page_idx, page_idx % 2 AS col_side, path AS img_path, CASE WHEN x0 + y0 + x1 + y1 IS NOT NULL THEN x0 END AS x0, CASE WHEN x0 + y0 + x1 + y1 IS NOT NULL THEN y1 END AS y1 FROM page_images WHERE path IS NOT NULL",
    "img_pages": f"SELECT doc_id, page_idx FROM blocks WHERE block_type = 'image' UNION SELECT i.doc_id, coalesce(try_cast({B.ext(_NAME('i.path'), 'page[_ -]*([0-9]+)', 1)} AS INTEGER) - 1, i.page_idx) AS page_idx FROM page_images i WHERE path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = i.doc_id AND {_NAME('b.img_path')} = {_NAME('i.path')})",
    "img_page_map": f"WITH {B.QUESTIONS}, i AS (SELECT DISTINCT doc_id, page_idx, path, y0 FROM page_images WHERE path IS NOT NULL), g AS (SELECT doc_id, page_idx, count(*)::INTEGER AS n, arg_min(path, (coalesce(y0, -1e308), path)) AS first_path FROM i GROUP BY ALL), dd AS (SELECT DISTINCT doc_id FROM i) SELECT question_id, coalesce(n, 0) AS n_images, first_path FROM qs JOIN dd USING (doc_id) LEFT JOIN g ON g.doc_id = qs.doc_id AND g.page_idx = qs.source_page",
    "block_centres": f"{_B} SELECT doc_id, page_idx // 2 AS sheet, page_idx % 2 AS side, round(avg(coalesce((x0 + x1) / 2, 500)), 4) AS x_mid, round(avg(coalesce((y0 + y1) / 2, page_idx * 10000.0)), 4) AS y_mid, count(*) AS n FROM b GROUP BY ALL",
    "a3_pages": f"{_B}, p AS (SELECT doc_id, page_idx, max(col_side) = 1 AS wide FROM b GROUP BY ALL) SELECT doc_id, page_idx, CASE WHEN side >= 0 THEN 2 * page_idx + side ELSE page_idx END AS long_page, CASE side WHEN 0 THEN 'P' || page_idx || 'L' WHEN 1 THEN 'P' || page_idx || 'R' END AS mark FROM (SELECT *, unnest(CASE WHEN wide THEN [0, 1] ELSE [-1] END) AS side FROM p)",
    "a3_sides": "WITH q AS (SELECT DISTINCT doc_id, q_ord, q_index FROM questions), m AS (SELECT doc_id, CASE WHEN max(q_index) <= 10 THEN max(q_index) ELSE 10 END AS mid FROM q GROUP BY ALL) SELECT doc_id, q_ord, (q_index > mid)::INTEGER AS side FROM q JOIN m USING (doc_id)",
    "a3_join": "WITH q AS (SELECT DISTINCT doc_id, q_ord, q_index, col_side FROM questions), n AS (SELECT doc_id, count(*)::INTEGER AS n FROM q WHERE col_side <= 0 GROUP BY ALL) SELECT * FROM q WHERE col_side <= 0 UNION ALL SELECT q.doc_id, q_ord, q_index + coalesce(n, 0), col_side FROM q LEFT JOIN n USING (doc_id) WHERE col_side = 1",
    "layout_ranges": f"WITH {B.QUESTIONS}, g AS (SELECT doc_id, source_page AS page_idx, is_multi_select AS m, min(q_index) AS a, max(q_index) AS b FROM qs WHERE is_multi_select IS NOT NULL AND source_page < 5 GROUP BY ALL) SELECT doc_id, page_idx, CASE WHEN m THEN 'multi' ELSE 'single' END AS kind, unnest(range(a, b + 1))::INTEGER AS qnum FROM g",
    "layout_multi": f"WITH {B.QUESTIONS}, k AS (SELECT doc_id, source_page, q_index, bool_or(is_multi_select) AS m FROM qs WHERE is_multi_select IS NOT NULL AND source_page < 5 GROUP BY ALL) SELECT question_id, coalesce(m, CASE WHEN regexp_matches(coalesce(section_title, ''), '多选|多项') THEN true WHEN regexp_matches(coalesce(section_title, ''), '单选|单项') THEN false END) AS multi_tag FROM qs LEFT JOIN k USING (doc_id, source_page, q_index)",
}
