"""Queries of records, block lists, rendering, fonts and choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import rx
from quire.functions.choices import parse_choices
from quire.operators import blocklist as K
from quire.operators import fonts
from quire.operators import records as R
from quire.operators import render
from quire.operators import segment as S
from quire.operators.running import running
from quire.plans import sqlbits as B
from quire.plans.texts import _MD, question_md
from quire.session import materialise
from quire.session import table as t

NOW = "2024-01-15 00:00:00"


def dedup_exact(s: SparkSession, d: str) -> DataFrame:
    b = t(s, d, "blocks").select("block_id", "content").distinct()
    return R.dedup_exact(b, "content", "block_id").select("block_id", "kept_id", "is_new", "content_key")


def dedup_jaccard(s: SparkSession, d: str) -> DataFrame:
    return R.dedup_jaccard(question_md(s, d), "content_md", "question_id").withColumn("similarity", F.round("similarity", 9))


def dedup_jaccard_members(s: SparkSession, d: str) -> DataFrame:
    """Every question with the representative that stands for it in dedup_jaccard."""
    return R.jaccard_members(question_md(s, d), "content_md", "question_id")


def bank_insert(s: SparkSession, d: str) -> DataFrame:
    """Summary of inserting scanned exams' blocks into a bank of all others."""
    scan = t(s, d, "exams").filter("source IN ('flatbed_scan', 'phone_scan')").select("doc_id").distinct()
    b = t(s, d, "blocks").select("block_id", "doc_id", "content").distinct()
    return R.insert_new(b.join(scan, "doc_id", "left_anti"), b.join(scan, "doc_id", "left_semi"), "content")[1]


def question_texts(s: SparkSession, d: str) -> DataFrame:
    """(question_id, doc_id, content_md) of question_md by one shuffle: questions and blocks are grouped together, and redelivered rows collapse in the sets."""
    q, b = t(s, d, "questions").drop("ingested_at"), t(s, d, "blocks")
    b = b.filter("block_type = 'text' AND doc_id IS NOT NULL AND q_ord IS NOT NULL AND content IS NOT NULL").select("doc_id", "q_ord", F.struct("block_ord", "block_id", "content").alias("block"))
    rest = F.struct(*[c for c in q.columns if c not in ("doc_id", "q_ord")]).alias("question")
    # questions that no block can belong to don't meet in one group
    q = q.select("doc_id", "q_ord", F.when(F.col("doc_id").isNull() | F.col("q_ord").isNull(), F.col("question_id")).alias("alone"), rest)
    g = q.unionByName(b, allowMissingColumns=True).groupBy("doc_id", "q_ord", "alone").agg(F.collect_set("question").alias("qs"), F.array_sort(F.collect_set("block")).alias("bs"))
    g = g.filter(F.size("qs") > 0).select("doc_id", F.explode("qs").alias("q"), F.transform("bs", lambda x: x["content"]).alias("body"))
    opts = F.filter(F.coalesce("q.options", F.array().cast("array<string>")), lambda x: x.isNotNull())
    return g.select("q.question_id", "doc_id", F.array_join(F.concat(F.array(F.coalesce("q.label", F.lit(""))), "body", opts), "\n").alias("content_md"))


def bank_similar(s: SparkSession, d: str) -> DataFrame:
    """What becomes of every question offered to a bank of the loose items."""
    q = materialise(question_texts(s, d))
    loose = F.coalesce(F.col("doc_id") == "bank-omnibus-0001", F.lit(False))
    r = R.insert_similar(q.filter(loose), q.filter(~loose), "content_md", "question_id")
    return r.select(F.col("id").alias("question_id"), "is_new", F.round("similarity", 9).alias("similarity"), "reason")


def assemble_sections(s: SparkSession, d: str) -> DataFrame:
    """Parts in which questions are shown: a third of the exams has buckets K1 to K5, a third some of them, a third none."""
    q = S.distinct_questions(t(s, d, "questions")).withColumn("kind", F.length("doc_id") % 3)
    bucket = F.when(F.col("kind") == 0, F.concat(F.lit("K"), (F.col("q_ord") % 5 + 1).cast("string"))).when((F.col("kind") == 1) & (F.col("q_ord") % 4 > 0), F.concat(F.lit("K"), (F.col("q_ord") % 4).cast("string")))
    return render.assemble(q.withColumn("bucket", bucket)).select("question_id", "section")


def latest_exam(s: SparkSession, d: str) -> DataFrame:
    """The last delivered row of every exam."""
    return R.latest_per_key(t(s, d, "exams").select("doc_id", "title", "source", "created_at"), ["doc_id"], "created_at")


def fetch_paper(s: SparkSession, d: str) -> DataFrame:
    q = t(s, d, "questions").select("question_id", F.col("doc_id").alias("source_paper"), F.lpad(F.col("q_index").cast("string"), 2, "0").alias("source_qnum"), F.col("ingested_at").alias("created_at"))
    return R.fetch_paper(q, "bank-omnibus-0001", F.lit("2999-01-01").cast("timestamp_ntz"))


def recent_files(s: SparkSession, d: str) -> DataFrame:
    return R.recent(t(s, d, "events"), "ts", F.lit(NOW).cast("timestamp_ntz"), 24).select("event_id", "user_id")


def live_jobs(s: SparkSession, d: str) -> DataFrame:
    return R.live_jobs(t(s, d, "events").filter("ts < '2024-01-15'"), "ts", "event_id", F.lit(NOW).cast("timestamp_ntz"), 240.0).select("event_id")


def throttle(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "events")
    last = F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", R.throttled(last, F.lit(NOW).cast("timestamp"), F.col("event_type") == "error").alias("waits"))


def semver(s: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    v = lambda k: F.concat_ws(".", (p % k).cast("string"), (p % 13).cast("string"), (F.col("p_size") % 11).cast("string"))
    latest = F.when(p % 9 == 0, "1.2").when(p % 10 == 0, F.concat(v(3), F.lit("-beta"))).otherwise(v(3))
    return t(s, d, "part").select("p_partkey", R.is_newer(latest, v(2)).alias("newer"))


def preflight(s: SparkSession, d: str) -> DataFrame:
    p = t(s, d, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, ".txt").otherwise(".PDF")).alias("path"), (F.col("p_size").cast("bigint") * 3_000_000).alias("length"), (F.col("p_partkey") % 11 == 0).alias("encrypted"))
    return R.preflight(p).select("p_partkey", "error")


def content_list(s: SparkSession, d: str) -> DataFrame:
    """Blocks of each page as a JSON list and back."""
    b = t(s, d, "blocks").drop("ingested_at").distinct()
    lists = K.to_content_list(b, ["doc_id", "page_idx"]).select(F.concat_ws("#", "doc_id", F.col("page_idx").cast("string")).alias("doc_id"), "items")
    return K.parse_content_list(lists).select("doc_id", F.col("item_pos").alias("pos"), "block_type", "content", "img_path", "text_level", F.get("bbox", F.lit(0)).alias("x0"))


def event_props(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def render_cards(s: SparkSession, d: str) -> DataFrame:
    q = question_md(s, d).select("doc_id", "q_ord", "q_index", "content_md", F.col("question_type").alias("q_type"), F.col("is_multi_select").alias("multi"))
    return render.cards(q).select("doc_id", "seq", F.md5("html").alias("html_md5"))


def exam_totals(s: SparkSession, d: str) -> DataFrame:
    """Questions, range of numbers, and whether all of an exam's questions say page 0."""
    return S.distinct_questions(t(s, d, "questions")).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("q_index").alias("first"), F.max("q_index").alias("last"), F.bool_and(F.col("source_page") == 0).alias("flat"), F.count_if(F.col("question_type") == "choice").alias("choices"))


def _font_lines(s: SparkSession, d: str) -> DataFrame:
    return S.exam_lines(t(s, d, "blocks"), t(s, d, "questions")).withColumn("size", 9 + F.pmod(F.col("block_id"), F.lit(5)).cast("double"))


def qnum_font(s: SparkSession, d: str) -> DataFrame:
    return fonts.font_qnums(_font_lines(s, d))


def page_text_dict(s: SparkSession, d: str) -> DataFrame:
    """Lines of every page out of its nested text, which is made of the page's blocks: a span for each half of a line."""
    n = _font_lines(s, d).withColumn("half", (F.length("line") / 2).cast("int"))
    span = lambda size, text: F.struct(size.alias("size"), text.alias("text"))
    line = F.struct(F.array(F.lit(0.0), F.col("line_no").cast("double"), F.lit(9.0), F.lit(9.0)).alias("bbox"), F.array(span(F.col("size"), F.expr("left(line, half)")), span(F.lit(8.0), F.expr("substring(line, half + 1)"))).alias("spans"))
    b = n.groupBy("doc_id", "page_idx", "block_ord", "block_id").agg(F.struct(F.lit(0).alias("type"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("l")))), lambda x: x["l"]).alias("lines")).alias("b"))
    page = b.groupBy("doc_id", "page_idx").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "block_id", "b"))), lambda x: x["b"]).alias("blocks"))).alias("text_dict"))
    return fonts.text_dict_lines(page).select("doc_id", "page_idx", "block_ord", "line_no", "line", "size", "y")


def choices(s: SparkSession, d: str) -> DataFrame:
    return question_md(s, d).select("question_id", F.explode(parse_choices(F.col("content_md"))).alias("o")).groupBy("question_id").agg(F.count("*").alias("n_items"), F.count("o.letter").alias("n_options"), F.count_if("o.bare").alias("n_bare"))


def figure_flow(s: SparkSession, d: str) -> DataFrame:
    """Images kept by every question when each keeps what it refers to and hands the rest on.

    What is handed on is a queue: the running sum of images minus quota, less its running minimum. Both are two-level
    running aggregates, so an exam of any size is never in one task.
    """
    b = t(s, d, "blocks").drop("ingested_at").distinct().filter("q_ord IS NOT NULL")
    refs = F.sum(F.when(F.col("block_type") == "text", F.regexp_count(F.coalesce("content", F.lit("")), F.lit(S.FIGURE_REF))).otherwise(0))
    q = b.groupBy("doc_id", "q_ord").agg(F.when(refs > 0, refs).otherwise(99).alias("quota"), F.count_if((F.col("block_type") == "image") & F.col("img_path").isNotNull()).alias("n"))
    r = running(q, ["doc_id"], ["q_ord"], p=("sum", F.col("n") - F.col("quota")))
    r = running(r, ["doc_id"], ["q_ord"], low=("max", -F.col("p")))
    handed = F.col("p") + F.greatest(F.lit(0), F.col("low"))
    return r.select("doc_id", "q_ord", F.col("n").alias("n_images"), handed.alias("handed_on"))


_EX = "WITH q AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM questions)"
_FONT = (
    f"WITH {B.LINES}, l AS (SELECT *, 9 + (block_id % 5)::DOUBLE AS size, trim(line) AS t, rtrim(lag(line) OVER (PARTITION BY block_id ORDER BY line_no)) AS prev FROM lines),"
    f" bl AS (SELECT doc_id, page_idx, block_ord, block_id, bool_or(regexp_matches(line, '[一-鿿]')) AS bh FROM lines GROUP BY ALL),"
    " nx AS (SELECT block_id, bh, coalesce(bool_or(bh) OVER (PARTITION BY doc_id, page_idx ORDER BY block_ord, block_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false) AS nh FROM bl),"
    " a AS (SELECT l.*, bh, nh, regexp_replace(t, '^\\s*[0-9]{1,2}\\s*[.．、]', '') AS aft FROM l JOIN nx USING (block_id) WHERE regexp_matches(t, '^\\s*[0-9]{1,2}\\s*[.．、]')),"
    " ok AS (SELECT *, ltrim(aft) AS near FROM a WHERE (NOT regexp_matches(aft, '^[0-9]') OR regexp_matches(aft, '^(?:19|20)[0-9]{2}')) AND NOT coalesce(length(prev) >= 3 AND regexp_matches(prev, '[=+×÷∗／−]$'), false) AND size BETWEEN 10 AND 12"
    f" AND NOT (page_idx = 0 AND {B.has('t', fonts.INSTRUCTION)})),"
    " y AS (SELECT *, try_cast(regexp_extract(t, '^\\s*([0-9]{1,2})', 1) AS INTEGER) AS qnum FROM ok WHERE CASE WHEN regexp_matches(near, '^[0-9]') THEN regexp_matches(near, '^[0-9. ]+[^\\x00-\\x7f]') AND regexp_matches(left(near, 6), '[一-鿿℃℉]') WHEN regexp_matches(aft, '[一-鿿]') THEN true WHEN trim(aft) = '' THEN bh OR nh ELSE true END)"
    " SELECT doc_id, page_idx, arg_min(block_id, (block_ord, block_id, line_no)) AS block_id, arg_min(line_no, (block_ord, block_id, line_no)) AS line_no, qnum, arg_min(left(t, 60), (block_ord, block_id, line_no)) AS shown FROM y GROUP BY doc_id, page_idx, qnum"
)
_W = f"regexp_extract_all(lower(content_md), '[a-zà-ÿ0-9]+|{rx.HAN}')"
QUERIES = {f.__name__: f for f in (dedup_exact, dedup_jaccard, dedup_jaccard_members, bank_insert, bank_similar, assemble_sections, latest_exam, fetch_paper, recent_files, live_jobs, throttle, semver, preflight, content_list, event_props, render_cards, exam_totals, qnum_font, page_text_dict, choices, figure_flow)}
_KEY = lambda c: f"sha256({B.sub(f'''lower(coalesce({c}, ''))''', f'{rx.S}+', '')})"
_CARD = (
    "'<section class=\"q\" id=\"q' || seq || '\"><span class=\"badge\">' || CASE question_type WHEN 'choice' THEN CASE WHEN is_multi_select IS NULL THEN '选择' WHEN is_multi_select THEN '多选' ELSE '单选' END WHEN 'fill_blank' THEN '填空' WHEN 'calculation' THEN '计算' WHEN 'experiment' THEN '实验' ELSE '其他' END"
    " || '</span><b>' || lpad(coalesce(q_index, 0)::VARCHAR, 2, '0') || '</b><div>' || body || '</div></section>'"
)
_ESC = "replace(replace(replace(content_md, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_LATEX = "translate(replace(" + B.sub(_ESC, "(\\$\\$[\\s\\S]+?\\$\\$|\\$[^$\\n]+?\\$)|" + f"((?i:\\\\(?:{rx.LATEX_COMMANDS})(?:\\{{[^{{}}]*\\}})?(?:\\{{[^{{}}]*\\}})?))", "\\1\x01\\2\x02") + ", '\x01\x02', ''), '\x01\x02', '$$')"
ORACLE = {
    "dedup_exact": f"WITH b AS (SELECT DISTINCT block_id, content FROM blocks), k AS (SELECT block_id, {_KEY('content')} AS content_key FROM b) SELECT block_id, min(block_id) OVER (PARTITION BY content_key) AS kept_id, block_id = min(block_id) OVER (PARTITION BY content_key) AS is_new, content_key FROM k",
    "dedup_jaccard": f"{_MD}, w AS (SELECT question_id AS id, {_W} AS w FROM md), s AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM w WHERE len(w) >= 5), r AS (SELECT s, min(id) AS id FROM s GROUP BY s), e AS (SELECT id, len(s) AS n, unnest(s) AS h FROM r),"
    " c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.h = b.h AND a.id < b.id GROUP BY ALL) SELECT id_a, id_b, round(k / (na + nb - k), 9) AS similarity FROM c WHERE k / (na + nb - k) >= 0.8 - 1e-9",
    "dedup_jaccard_members": f"{_MD}, w AS (SELECT question_id AS id, {_W} AS w FROM md), s AS (SELECT id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) ELSE [id::VARCHAR] END AS s FROM w)"
    " SELECT id, min(id) OVER (PARTITION BY s) AS kept_id, count(*) OVER (PARTITION BY s) AS n_equal FROM s",
    "bank_insert": f"WITH b AS (SELECT DISTINCT block_id, doc_id, {_KEY('content')} AS k FROM blocks), s AS (SELECT DISTINCT doc_id FROM exams WHERE source IN ('flatbed_scan', 'phone_scan')), d AS (SELECT * FROM b WHERE doc_id IN (SELECT doc_id FROM s)), o AS (SELECT k FROM b WHERE doc_id NOT IN (SELECT doc_id FROM s)), n AS (SELECT count(*) AS drafts, count(DISTINCT k) FILTER (WHERE k NOT IN (SELECT k FROM o)) AS inserted FROM d) SELECT *, drafts - inserted AS skipped FROM n",
    "bank_similar": f"{_MD}, x AS (SELECT question_id AS id, CASE WHEN coalesce(doc_id = 'bank-omnibus-0001', false) THEN 0 ELSE 1 END AS side, {_KEY('content_md')} AS k, {_W} AS w FROM md), y AS (SELECT side, id, k, (side, id) AS me, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) ELSE [] END AS sh FROM x),"
    " f AS (SELECT *, min(me) OVER (PARTITION BY k) AS first, CASE WHEN len(sh) > 0 THEN min(me) OVER (PARTITION BY sh) ELSE me END AS rep FROM y), e AS (SELECT me, len(sh) AS n, unnest(sh) AS h FROM f WHERE rep = me AND len(sh) > 0),"
    " c AS (SELECT b.me AS me, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS sim FROM e a JOIN e b ON a.h = b.h AND a.me < b.me GROUP BY a.me, b.me), m AS (SELECT me, max(sim) AS sim FROM c WHERE sim >= 0.8 - 1e-9 GROUP BY me)"
    " SELECT id AS question_id, first = f.me AND rep = f.me AND sim IS NULL AS is_new, round(CASE WHEN first <> f.me OR rep <> f.me THEN 1.0 ELSE coalesce(sim, 0.0) END, 9) AS similarity, CASE WHEN first <> f.me THEN 'exact' WHEN rep <> f.me OR sim IS NOT NULL THEN 'near_dup' ELSE 'new' END AS reason FROM f LEFT JOIN m ON f.me = m.me WHERE side = 1",
    "assemble_sections": f"{_EX}, b AS (SELECT *, CASE length(doc_id) % 3 WHEN 0 THEN 'K' || (q_ord % 5 + 1) WHEN 1 THEN CASE WHEN q_ord % 4 > 0 THEN 'K' || (q_ord % 4) END END AS bucket FROM q), s AS (SELECT doc_id, count(DISTINCT bucket) = 5 AND count(bucket) = count(*) OR count(bucket) = 0 AS flat FROM b GROUP BY doc_id) SELECT question_id, CASE WHEN flat THEN '_all' ELSE coalesce(bucket, '_rest') END AS section FROM b JOIN s USING (doc_id)",
    "latest_exam": "SELECT doc_id, title, source, created_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, title DESC NULLS LAST, source DESC NULLS LAST) AS r FROM exams) WHERE r = 1",
    "fetch_paper": "SELECT question_id, doc_id AS source_paper, lpad(q_index::VARCHAR, 2, '0') AS source_qnum, ingested_at AS created_at FROM questions WHERE doc_id = 'bank-omnibus-0001'",
    "recent_files": f"SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS",
    "live_jobs": f"SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-15' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 240 HOURS ORDER BY ts DESC, event_id DESC LIMIT 1000",
    "throttle": f"SELECT event_id, coalesce(event_type <> 'error' AND event_id % 7 <> 0 AND date_trunc('second', ts) > TIMESTAMP '{NOW}' - INTERVAL 24 HOURS, false) AS waits FROM events",
    "semver": "WITH v AS (SELECT p_partkey, p_partkey % 3 AS a, p_partkey % 2 AS b, p_partkey % 13 AS m, p_size % 11 AS p FROM part) SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN (a, m, p) > (b, m, p) END AS newer FROM v",
    "preflight": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'NOT_A_PDF' WHEN p_size * 3000000 > 104857600 THEN 'FILE_TOO_LARGE' WHEN p_partkey % 11 = 0 THEN 'PDF_ENCRYPTED' END AS error FROM part",
    "content_list": "WITH b AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM blocks) SELECT doc_id || '#' || page_idx AS doc_id, (row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY block_ord, block_id) - 1)::INTEGER AS pos, block_type, coalesce(content, '') AS content, img_path, text_level, bbox[1] AS x0 FROM b",
    "event_props": "SELECT event_id, try_cast(props->>'$.k' AS INTEGER) AS k FROM events",
    "render_cards": f"{_MD}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(q_index, 0), q_ord) AS seq, replace({B.sub(B.sub(_LATEX, '[ \\t]+(\\n)', '\\1'), '[ \\t]{2,}', '\x01')}, '\x01', ' ') AS body FROM md) SELECT doc_id, seq, md5({_CARD}) AS html_md5 FROM n",
    "exam_totals": f"{_EX} SELECT doc_id, count(*) AS n, min(q_index) AS first, max(q_index) AS last, bool_and(source_page = 0) AS flat, count(*) FILTER (WHERE question_type = 'choice') AS choices FROM q GROUP BY doc_id",
    "qnum_font": _FONT,
    "page_text_dict": f"WITH {B.LINES}, o AS (SELECT doc_id, page_idx, block_ord AS bo, block_id, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY block_ord, block_id) - 1 AS block_ord FROM (SELECT DISTINCT doc_id, page_idx, block_ord, block_id FROM lines)) SELECT l.doc_id, l.page_idx, o.block_ord::INTEGER AS block_ord, line_no, line, 9 + (l.block_id % 5)::DOUBLE AS size, line_no::DOUBLE AS y FROM lines l JOIN o ON o.doc_id = l.doc_id AND o.page_idx = l.page_idx AND o.bo = l.block_ord AND o.block_id = l.block_id",
    "figure_flow": "WITH b AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM blocks WHERE q_ord IS NOT NULL), r AS (SELECT doc_id, q_ord, sum(CASE WHEN block_type = 'text' THEN len(regexp_extract_all(replace(replace(replace(coalesce(content, ''), '　', ''), ' ', ''), chr(10), ''), '图[(（]?[a-zA-Z0-9一二三四五甲乙丙丁]')) ELSE 0 END) AS refs, count(*) FILTER (WHERE block_type = 'image' AND img_path IS NOT NULL) AS n FROM b GROUP BY ALL),"
    " p AS (SELECT *, sum(n - CASE WHEN refs > 0 THEN refs ELSE 99 END) OVER w AS p FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY q_ord)) SELECT doc_id, q_ord, n AS n_images, (p - least(0, min(p) OVER (PARTITION BY doc_id ORDER BY q_ord)))::BIGINT AS handed_on FROM p",
}
