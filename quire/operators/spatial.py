"""Matching figures to questions by position and by path. All joins have (document, page) as equality keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import basename

PAGE_HEIGHT = 842.0
#: pixel area under which an image is a symbol and no figure; the narrowest real figure measured was larger
MIN_IMAGE_AREA = 8000.0


def box(c: str = "bbox") -> dict:
    """Ordered corners of a box that may be null or inverted."""
    b = F.col(c)
    ok = F.size(b) == 4
    pick = lambda f, i, j: F.when(ok, f(F.get(b, F.lit(i)), F.get(b, F.lit(j))))
    return {"x0": pick(F.least, 0, 2), "x1": pick(F.greatest, 0, 2), "y0": pick(F.least, 1, 3), "y1": pick(F.greatest, 1, 3)}


def centres(blocks: DataFrame) -> DataFrame:
    """blocks with x_mid, y_mid and the page and side of a two-column scan; without a box the centre is a page apart."""
    b = box()
    return blocks.withColumns({"x_mid": F.coalesce((b["x0"] + b["x1"]) / 2, F.lit(500.0)), "y_mid": F.coalesce((b["y0"] + b["y1"]) / 2, F.col("page_idx") * 10000.0), "sheet": F.expr("page_idx div 2"), "side": F.pmod("page_idx", F.lit(2))})


def with_positions(blocks: DataFrame) -> DataFrame:
    """y of every block; images without a box are spread over the page by their rank among its images."""
    w = W.partitionBy("doc_id", "page_idx", "block_type")
    rank = F.row_number().over(w.orderBy("block_ord", "block_id")) - 1
    n = F.count("*").over(w)
    return blocks.withColumn("y", F.coalesce(box()["y0"], rank / n * F.lit(PAGE_HEIGHT)))


def images_by_range(blocks: DataFrame) -> DataFrame:
    """(block_id, q_ord, assigned): the question of a page's column whose range [its y, the next one's y) holds the image, else the
    last question of that column; null if the column has none. Images without a column (other than 0 and 1) are matched
    with the questions of the whole page.

    An as-of join by one sort: questions and images of a column in one order, the last question so far carried on.
    """
    side = F.col("col_side") if "col_side" in blocks.columns else F.lit(-1)
    p = with_positions(blocks).withColumn("side", F.when(side.isin(0, 1), side).otherwise(-1))
    q = p.filter("q_ord IS NOT NULL AND block_type != 'image'").groupBy("doc_id", "page_idx", "side", F.col("q_ord").alias("q")).agg(F.min("y").alias("y"))
    page = q.groupBy("doc_id", "page_idx", "q").agg(F.min("y").alias("y")).withColumn("side", F.lit(-1))
    q = q.filter("side >= 0").unionByName(page)
    i = p.filter("block_type = 'image'").select("doc_id", "page_idx", "side", "y", "block_id", "q_ord", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("q"))
    q = q.select("doc_id", "page_idx", "side", "y", F.lit(None).cast("bigint").alias("block_id"), F.lit(None).cast("int").alias("q_ord"), F.lit(0).alias("kind"), "q")
    w = W.partitionBy("doc_id", "page_idx", "side")
    u = q.unionByName(i).withColumn("here", F.last("q", ignorenulls=True).over(w.orderBy("y", "kind", "q", "block_id").rowsBetween(W.unboundedPreceding, 0))).withColumn("final", F.max_by("q", F.when(F.col("kind") == 0, F.struct("y", "q"))).over(w))
    return u.filter("kind = 1").select("block_id", "q_ord", F.coalesce("here", "final").alias("assigned"))


def images_by_nearest(blocks: DataFrame) -> DataFrame:
    """(block_id, q_ord, assigned): the question of the text block that contains the image's middle (the uppermost such), else of
    the closest one wholly above, else the image's own question, else the first on the page that speaks of a figure."""
    b = box()
    p = blocks.withColumns({"y0": b["y0"], "y1": b["y1"]})
    i = p.filter("block_type = 'image'").select("block_id", "doc_id", "page_idx", F.col("q_ord").alias("own"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    t = p.filter("block_type = 'text' AND q_ord IS NOT NULL").select("doc_id", "page_idx", F.col("q_ord").alias("q"), "y0", "y1", F.coalesce(F.col("content").contains("如图"), F.lit(False)).alias("refers"))
    j = i.join(t, ["doc_id", "page_idx"], "left")
    holds = (F.col("y0") <= F.col("y")) & (F.col("y") <= F.col("y1"))
    above = F.col("y1") < F.col("y")
    r = j.groupBy("block_id", "own").agg(F.min_by("q", F.when(holds, F.struct("y0", "q"))).alias("inside"), F.max_by("q", F.when(above, F.struct("y0", "q"))).alias("over"), F.min(F.when(F.col("refers"), F.col("q"))).alias("first_ref"))
    return r.select("block_id", F.col("own").alias("q_ord"), F.coalesce("inside", "over", "own", "first_ref").alias("assigned"))


def relink_images(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, path, block_id, how): image files matched to blocks by exact path, else by file name, else orphan (null block)."""
    i = images.filter("path IS NOT NULL").select("doc_id", "path").distinct()
    b = blocks.filter("img_path IS NOT NULL").select("doc_id", F.col("img_path").alias("p"), "block_id").distinct()
    exact = b.groupBy("doc_id", F.col("p").alias("path")).agg(F.min("block_id").alias("exact"))
    named = b.groupBy("doc_id", basename(F.col("p")).alias("name")).agg(F.min("block_id").alias("named"))
    j = i.withColumn("name", basename(F.col("path"))).join(exact, ["doc_id", "path"], "left").join(named, ["doc_id", "name"], "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("named").isNotNull(), "name").otherwise("orphan")
    return j.select("doc_id", "path", F.coalesce("exact", "named").alias("block_id"), how.alias("how"))


def orphan_images(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page_idx, path): image files that no block shows, by path or file name. The page comes from the name if it tells."""
    i = images.filter("path IS NOT NULL").select("doc_id", "page_idx", "path", basename(F.col("path")).alias("name")).distinct()
    b = blocks.filter("img_path IS NOT NULL").select("doc_id", basename(F.col("img_path")).alias("name")).distinct()
    page = F.regexp_extract("name", r"page[_\s-]*(\d+)", 1)
    return i.join(b, ["doc_id", "name"], "left_anti").select("doc_id", F.when(page != "", page.cast("int") - 1).otherwise(F.col("page_idx")).alias("page_idx"), "path")


def fill_image_paths(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """(block_id, img_path): image blocks without a path get the last image of their page, if there is one."""
    last = images.filter("path IS NOT NULL").groupBy("doc_id", "page_idx").agg(F.max_by("path", F.struct("y0", "path")).alias("last"))
    return blocks.filter("block_type = 'image'").join(last, ["doc_id", "page_idx"], "left").select("block_id", F.coalesce("img_path", "last").alias("img_path"))


def real_images(images: DataFrame, min_area: float = MIN_IMAGE_AREA) -> DataFrame:
    """Images but the tiny ones; unknown sizes are kept, and min_area <= 0 keeps all."""
    area = F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return images if min_area <= 0 else images.filter(~F.coalesce(area < min_area, F.lit(False)))


def image_warnings(blocks: DataFrame, gap: float = 200.0) -> DataFrame:
    """(block_id, no_reference, far): images whose question doesn't mention a figure, or lies more than ``gap`` aside on the page."""
    c = centres(blocks)
    q = c.filter("block_type = 'text' AND q_ord IS NOT NULL").groupBy("doc_id", "q_ord", "page_idx").agg(F.avg("x_mid").alias("qx"), F.max(F.coalesce(F.col("content").rlike("图|(?i)fig"), F.lit(False))).alias("mentions"))
    i = c.filter("block_type = 'image' AND q_ord IS NOT NULL").select("block_id", "doc_id", "q_ord", "page_idx", "x_mid")
    r = i.join(q, ["doc_id", "q_ord", "page_idx"]).select("block_id", (~F.col("mentions")).alias("no_reference"), (F.abs(F.col("x_mid") - F.col("qx")) > gap).alias("far"))
    return r.filter("no_reference OR far")


def split_sheets(pages: DataFrame, width: str = "width", least: float = 900.0) -> DataFrame:
    """Wide pages become two: long_page 2n (left) and 2n + 1 (right) with a mark ``PnL`` or ``PnR``; narrow ones stay."""
    wide = F.coalesce(F.col(width) >= least, F.lit(False))
    two = pages.withColumn("side", F.explode(F.when(wide, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(-1)))))
    return two.withColumn("long_page", F.when(F.col("side") >= 0, 2 * F.col("page_idx") + F.col("side")).otherwise(F.col("page_idx"))).withColumn("mark", F.when(F.col("side") >= 0, F.concat(F.lit("P"), F.col("page_idx").cast("string"), F.when(F.col("side") == 0, "L").otherwise("R"))))


def join_sides(left: DataFrame, right: DataFrame, index: str = "q_index") -> DataFrame:
    """Questions of two half pages as one exam: the right ones are numbered on from the count of the left ones, per document."""
    n = left.groupBy("doc_id").agg(F.count("*").cast("int").alias("__n"))
    shifted = right.join(n, "doc_id", "left").withColumn(index, F.col(index) + F.coalesce("__n", F.lit(0))).drop("__n")
    return left.unionByName(shifted)


def infer_sides(questions: DataFrame) -> DataFrame:
    """(doc_id, q_ord, side): 0 up to the document's middle number, 1 beyond; the middle is the largest number up to 10, else 10."""
    m = questions.groupBy("doc_id").agg(F.when(F.max("q_index") <= 10, F.max("q_index")).otherwise(10).alias("mid"))
    return questions.join(m, "doc_id").select("doc_id", "q_ord", (F.col("q_index") > F.col("mid")).cast("int").alias("side"))


def embedded_images(images: DataFrame) -> DataFrame:
    """(doc_id, page_idx, col_side, img_path, bbox, block_type): the embedded images of all pages as raw image blocks.

    On a two-column scan taken apart the page's parity is its column. Images without a corner have no box; repeated rows
    and those without a path are left out.
    """
    corners = F.array("x0", "y0", "x1", "y1")
    box = F.when(F.forall(corners, lambda c: c.isNotNull()), corners)
    return images.filter("path IS NOT NULL").select("doc_id", "page_idx", F.pmod("page_idx", F.lit(2)).alias("col_side"), F.col("path").alias("img_path"), box.alias("bbox"), F.lit("image").alias("block_type")).distinct()


def figure_pages(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page_idx): pages with an image block or an orphan image, each once."""
    shown = blocks.filter("block_type = 'image'").select("doc_id", "page_idx")
    return shown.unionByName(orphan_images(images, blocks).select("doc_id", "page_idx")).distinct()


def page_map(images: DataFrame) -> DataFrame:
    """(doc_id, pages): page -> its image paths in order of height, as a map per document.

    A map of a document of any size is one value; where documents have no bound, join on (doc_id, page_idx) instead.
    """
    page = images.filter("path IS NOT NULL").select("doc_id", "page_idx", "path", "y0").distinct().groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(F.struct("y0", "path"))).alias("on"))
    page = page.select("doc_id", F.struct("page_idx", F.transform("on", lambda x: x["path"]).alias("paths")).alias("entry"))
    return page.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list("entry"))).alias("pages"))


def paths_on(pages: str, page: str):  # noqa: ANN201
    """The paths of a page out of a page map; no page, no paths."""
    return F.coalesce(F.element_at(F.col(pages), F.col(page)), F.array().cast("array<string>"))
