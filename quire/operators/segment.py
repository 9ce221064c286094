"""From blocks to lines to questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import classify as C
from quire.functions import rx
from quire.functions import text as X
from quire.functions.options import count_options, split_options
from quire.operators.running import running
from quire.session import materialise

BLOCK_COLUMNS = ["block_id", "doc_id", "block_ord", "q_ord", "block_type", "content", "page_idx", "text_level", "col_side"]


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks without redeliveries, which differ in the time of ingestion only: one row per block_id, hash-partitioned by it."""
    return blocks.select(*BLOCK_COLUMNS).dropDuplicates(["block_id"])


def distinct_questions(questions: DataFrame) -> DataFrame:
    return questions.drop("ingested_at").distinct()


def exam_lines(blocks: DataFrame, questions: DataFrame) -> DataFrame:
    """(doc_id, block_ord, block_id, line_no, page_idx, text_level, line): text blocks as lines, a question's label before its first block."""
    b = distinct_blocks(blocks).filter((F.col("block_type") == "text") & F.col("content").isNotNull())
    first = b.filter("q_ord IS NOT NULL").groupBy("doc_id", "q_ord").agg(F.min(F.struct("block_ord", "block_id")).alias("m"))
    label = questions.groupBy("doc_id", "q_ord").agg(F.min("label").alias("label")).join(first, ["doc_id", "q_ord"]).select(F.col("m.block_id").alias("block_id"), "label")
    t = b.join(label, "block_id", "left").withColumn("t", F.concat(F.when(F.col("label").isNotNull(), F.concat("label", F.lit(" "))).otherwise(""), "content"))
    return t.select("doc_id", "block_ord", "block_id", "page_idx", "text_level", F.posexplode(C.lines_of(F.col("t"))).alias("line_no", "line"))


def segment_lenient(lines: DataFrame) -> DataFrame:
    """(doc_id, seg, source_qnum, source_page, content_md, q_type): one row per question found in a document's lines.

    A top-level number in digits opens a question; a circled number does so only while no digits have been seen in the
    document. Lines before the first question, blank lines and empty questions are dropped.
    """
    order = ["block_ord", "block_id", "line_no"]
    n = lines.select("doc_id", *order, "page_idx", "line", C.digit_top(F.col("line")).alias("d"), C.circled_top(F.col("line")).alias("c"))
    # written once: the aggregates below then read two number columns instead of parsing all text again
    n = materialise(n.filter((X.strip(F.col("line")) != "")))
    first = n.filter("d IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*order)).alias("first_digit"))
    n = n.join(first, "doc_id", "left").withColumn("num", F.coalesce("d", F.when(F.col("first_digit").isNull() | (F.struct(*order) < F.col("first_digit")), F.col("c")))).drop("d", "c", "first_digit")
    n = running(n, ["doc_id"], order, seg=("sum", F.col("num").isNotNull().cast("int"))).filter("seg > 0")
    g = n.groupBy("doc_id", "seg").agg(F.array_sort(F.collect_list(F.struct(*order, "num", "page_idx", "line"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    out = g.select("doc_id", "seg", X.pad_qnum(F.col("rows")[0]["num"]).alias("source_qnum"), F.col("rows")[0]["page_idx"].alias("source_page"), X.strip(body).alias("content_md")).filter("content_md != ''")
    return out.withColumn("q_type", C.question_type(F.col("content_md"), F.lit("fill_blank")))


def attach_page_images(segments: DataFrame, images: DataFrame) -> DataFrame:
    """The k-th question that starts on a page gets the k-th image of that page, as a path and as a link at its end."""
    q = segments.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "source_page").orderBy("seg")))
    i = images.select("doc_id", F.col("page_idx").alias("source_page"), "path", "y0").filter("path IS NOT NULL").distinct()
    i = i.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "source_page").orderBy("y0", "path"))).drop("y0")
    j = q.join(i, ["doc_id", "source_page", "k"], "left")
    return j.withColumn("content_md", F.when(F.col("path").isNotNull(), F.concat("content_md", F.lit("\n![图](images/"), X.basename(F.col("path")), F.lit(")"))).otherwise(F.col("content_md"))).withColumnRenamed("path", "figure_path").drop("k")


def section_type(section, options, stem):  # noqa: ANN001, ANN201
    """Options make a choice; else the section's words decide."""
    return (
        F.when(options > 0, "choice").when(section.contains("实验"), "experiment").when(section.rlike("计算|解答"), "calculation").when(section.contains("填空"), "fill_blank").otherwise("unknown")
    )


def segment_markdown(lines: DataFrame) -> DataFrame:
    """(doc_id, seg, q_index, section, page, col_side, stem, options, q_type) from Markdown lines.

    Page marks ``P3L`` set page and column; ``## 一、`` sets the section; ``12.`` opens a question; lines that start with
    an option label are options while a question is open, and are split if several labels stand in them. An option line in
    which ``3.`` and a character beyond ASCII follow opens question 3 there, with the rest of the line as its stem. If a
    question has no options but its stem goes on with options after empty brackets, these are its options.
    """
    order = ["block_ord", "block_id", "line_no", "part"]
    t = F.col("line")
    n = lines.withColumn("line", X.clean_block(t)).filter((F.col("line") != "") & ~F.col("line").startswith("<!--"))
    mark = t.rlike("^P[0-9]+[LR]$")
    section = F.when(t.rlike(f"^##{rx.S}*[一二三四五六七八九十]+(?:{rx.DOT}|{rx.S})"), X.strip(F.substring(t, 3, 1 << 20)))
    opener = f"^({rx.D}{{1,3}})(?:{rx.DOT}|{rx.S})"
    number = lambda x: F.when(x != "", X.ascii_digits(x).cast("int"))
    n = n.withColumn("mark", mark).withColumn("sec", section)
    num = number(F.regexp_extract(t, opener, 1))
    n = n.withColumn("num", F.when(num.between(1, 50) & ~F.col("mark") & F.col("sec").isNull(), num))
    # a question that opens within an option line: the line becomes two parts
    inner = f"^([\\s\\S]*?)({rx.D}+)\\.([^\\x00-\\x7f][\\s\\S]*)$"
    n = n.withColumn("late", F.when(F.col("num").isNull() & t.rlike(rx.OPTION_START), number(F.regexp_extract(t, inner, 2))))
    n = materialise(n.select("doc_id", *order[:3], "line", "mark", "sec", "num", F.when(F.col("late").between(1, 50), F.col("late")).alias("late")))
    first = n.filter("num IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*order[:3])).alias("first"))
    n = n.join(first, "doc_id").withColumn("late", F.when(F.struct(*order[:3]) > F.col("first"), F.col("late"))).drop("first")
    whole = F.struct(F.lit(0).alias("part"), t.alias("line"), F.col("num").alias("num"), F.lit(False).alias("opened"))
    head = F.struct(F.lit(0).alias("part"), X.strip(F.regexp_extract(t, inner, 1)).alias("line"), F.lit(None).cast("int").alias("num"), F.lit(False).alias("opened"))
    tail = F.struct(F.lit(1).alias("part"), F.regexp_extract(t, inner, 3).alias("line"), F.col("late").alias("num"), F.lit(True).alias("opened"))
    n = n.withColumn("p", F.explode(F.when(F.col("late").isNull(), F.array(whole)).otherwise(F.array(head, tail)))).select("doc_id", *order[:3], "mark", "sec", "p.*")
    n = running(
        n, ["doc_id"], order,
        section=("last", F.col("sec")),
        page=("last", F.when(F.col("mark"), F.regexp_extract(t, "^P([0-9]+)", 1).cast("int"))),
        side=("last", F.when(F.col("mark"), t.endswith("R").cast("int"))),
        seg=("sum", F.col("num").isNotNull().cast("int")),
    )
    n = n.filter("seg > 0 AND NOT mark AND sec IS NULL").withColumn("opt", F.col("num").isNull() & t.rlike(rx.OPTION_START))
    n = n.withColumn("body", F.when(F.col("opened"), X.strip(t)).when(F.col("num").isNotNull(), X.strip(F.regexp_replace(t, opener, ""))).otherwise(t))
    g = n.groupBy("doc_id", "seg").agg(F.max("num").alias("q_index"), F.min_by("section", F.struct(*order)).alias("section"), F.min_by("page", F.struct(*order)).alias("page"), F.min_by("side", F.struct(*order)).alias("col_side"), F.array_sort(F.collect_list(F.struct(*order, "opt", "body"))).alias("rows"))
    stem = X.strip(F.array_join(F.transform(F.filter("rows", lambda r: ~r["opt"]), lambda r: r["body"]), "\n"))
    split = lambda b: F.when(count_options(b) >= 2, split_options(b)["options"]).otherwise(F.array(b))
    options = F.flatten(F.transform(F.filter("rows", lambda r: r["opt"]), lambda r: split(r["body"])))
    r = g.select("doc_id", "seg", "q_index", "section", "page", "col_side", stem.alias("stem"), options.alias("options"))
    # options behind empty brackets at the end of a stem
    after = f"^([\\s\\S]*?){rx.OPEN}{rx.S}*{rx.CLOSE}{rx.S}*([ABCD](?:{rx.DOT}|{rx.S})[^\\n]*)([\\s\\S]*)$"
    found = (F.size("options") == 0) & F.col("stem").rlike(after)
    pieces = F.filter(F.transform(F.split(F.regexp_extract("stem", after, 2), f"(?=[ABCD](?:{rx.DOT}|{rx.S}))"), X.strip), lambda x: x.rlike(rx.OPTION_START))
    r = r.withColumns({"options": F.when(found, pieces).otherwise(F.col("options")), "stem": F.when(found, X.strip(F.concat(X.rstrip(F.regexp_extract("stem", after, 1)), F.regexp_extract("stem", after, 3)))).otherwise(F.col("stem"))})
    return r.withColumn("q_type", section_type(F.coalesce("section", F.lit("")), F.size("options"), F.col("stem")))


#: a figure that a text refers to by a label
FIGURE_REF = f"图{rx.S}*[(（]?[a-zA-Z0-9一二三四五甲乙丙丁]"


def figure_quota(text, images):  # noqa: ANN001, ANN201
    """images of an exam's questions, in order -> images after the quota: a question keeps as many as it refers to (99 if it
    refers to none), the rest move on to the next question, and what the last one can't keep is lost.

    ``text``: array of question texts; ``images``: array of arrays of the same length.
    """
    pairs = F.arrays_zip(text.alias("t"), images.alias("i"))
    refs = lambda t: F.regexp_count(F.coalesce(t, F.lit("")), F.lit(FIGURE_REF))
    quota = lambda t: F.when(refs(t) > 0, refs(t)).otherwise(99)
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("rest"))

    def step(acc, x):  # noqa: ANN001, ANN202
        have = F.concat(acc["rest"], F.coalesce(x["i"], empty))
        return F.struct(F.concat(acc["done"], F.array(F.slice(have, 1, quota(x["t"])))).alias("done"), F.slice(have, quota(x["t"]) + 1, 1 << 20).alias("rest"))

    return F.aggregate(pairs, start, step, lambda a: a["done"])


def reattach_prose(c, flush: bool = True):  # noqa: ANN001, ANN201
    """Lines that continue an option are joined to it.

    Between two options they belong to the upper one; before the first option they are dealt out to the options that
    follow in order, and slots are made for those without an option. With ``flush`` what is pending at the end is kept.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("wait"), F.lit(-1).alias("last"))
    letters = F.array(*[F.lit(x) for x in "ABCDEF"])
    put = lambda a, i, v: F.transform(a, lambda x, j: F.when(j == i, v(x)).otherwise(x))

    def step(acc, x):  # noqa: ANN001, ANN202
        out, wait, last = acc["out"], acc["wait"], acc["last"]
        size = F.size(out)
        head = x.rlike(rx.OPTION_LINE)
        prose = ~head & C.is_option_prose(x)
        upper = (F.size(wait) > 0) & (last >= 0) & (last == size - 1)
        joined = put(out, last, lambda o: X.strip(F.concat(X.rstrip(o), F.array_join(wait, ""))))
        first = F.when(F.size(wait) > 0, X.strip(F.concat(X.rstrip(x), wait[0]))).otherwise(x)
        at = F.greatest(F.array_position(letters, F.upper(F.substring(X.strip(x), 1, 1))).cast("int") - 1, F.lit(0))
        extra = F.transform(F.slice(wait, 2, F.greatest(F.size(wait) - 1, F.lit(0))), lambda p, j: F.concat(F.get(letters, F.least(at + j + 1, F.lit(5))), F.lit(". "), X.strip(p)))
        dealt = F.concat(out, F.array(first), extra)
        on_head = F.struct(F.when(upper, F.concat(joined, F.array(x))).otherwise(dealt).alias("out"), none.alias("wait"), F.when(upper, size).otherwise(size).alias("last"))
        on_prose = F.struct(out.alias("out"), F.concat(wait, F.array(X.strip(x))).alias("wait"), last.alias("last"))
        other = F.struct(F.concat(out, F.array(x)).alias("out"), wait.alias("wait"), F.lit(-1).alias("last"))
        return F.when(head, on_head).when(prose, on_prose).otherwise(other)

    rest = lambda a: F.concat(a["out"], a["wait"]) if flush else a["out"]
    return F.when(c == "", c).otherwise(F.aggregate(F.split(c, "\n"), start, step, lambda a: F.array_join(rest(a), "\n")))


def distinct_paths(paths):  # noqa: ANN001, ANN201
    """Trimmed, non-blank, first occurrences in order; null is empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(paths, F.array().cast("array<string>")), lambda p: X.strip(F.coalesce(p, F.lit("")))), lambda p: p != ""))


def normalise(df: DataFrame, content: str = "content_md", q_type: str = "q_type", paths: str | None = None) -> DataFrame:
    """Questions with trimmed tails, reattached option prose, one option a line, no zero runs, a type, and distinct paths. Nothing is made up."""
    from quire.functions.options import split_inline_options

    c = X.ocr_noise(split_inline_options(reattach_prose(X.tail_trim(F.col(content)))))
    out = df.withColumn(content, c)
    out = out.withColumn(q_type, C.question_type(F.col(content), F.col(q_type)))
    return out.withColumn(paths, distinct_paths(F.col(paths))) if paths else out


# Units that a number at the beginning of a line may belong to, noise of a recogniser, words for a figure.
UNIT = f"^{rx.S}*(?:kg|m/|s/|J/s|[JNW] |[0-9]+\\.?[0-9]*{rx.S}*[a-zA-Z]{rx.S}*/{rx.S}*[a-zA-Z])"
NOISE = "ZZZZ|[{}][{}]|<<|>>|[?][?](?:\\s|$)"
FIGURE = "如图|图像|示意图"
#: how far below a question's last text a figure still belongs to it
BELOW = 50.0


def segment_blocks(blocks: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, block_id, block_ord, seg, q_index, section, t, opener, options): every block's question, in reading order.

    A text block that begins with a number of 1 to 50 (no option, and no unit after it) opens a question; headings set the
    section and belong to none, as does short noise. Equations before the first question belong to it, other such blocks are
    dropped. A figure belongs to the question that is open where it stands, or to the one before that if its text speaks
    of a figure, or if that has options and its last text ends less than BELOW above the figure's lower edge; figures before
    the first question belong to it, and figures after the last other block stay with the last question. ``labels``
    (block_id, label) are put before their blocks. ``t`` is the clean text, ``options`` whether the block is or has options.
    """
    b = blocks.select(*BLOCK_COLUMNS, "bbox").dropDuplicates(["block_id"]).filter("doc_id IS NOT NULL")
    if labels is not None:
        b = b.join(labels, "block_id", "left").withColumn("content", F.when(F.col("label").isNotNull(), F.concat_ws(" ", "label", "content")).otherwise(F.col("content"))).drop("label")
    text = F.col("block_type") == "text"
    t = X.clean_block(F.coalesce("content", F.lit("")))
    opener = f"^({rx.D}{{1,3}})(?:{rx.DOT}|{rx.S})"
    b = materialise(b.withColumn("t", t).select("doc_id", "block_ord", "block_id", "block_type", "text_level", "t", F.when(F.size("bbox") == 4, F.greatest(F.get("bbox", F.lit(1)), F.get("bbox", F.lit(3)))).alias("bottom")))
    num = X.ascii_digits(F.regexp_extract("t", opener, 1))
    rest = F.regexp_replace("t", opener, "")
    option = F.col("t").rlike(rx.OPTION_START)
    heading = text & (F.coalesce("text_level", F.lit(0)) == 1)
    noise = text & (F.length("t") < 30) & F.col("t").rlike(NOISE) & ~option
    n = b.withColumn("noise", noise).withColumn("heading", heading).withColumn("num", F.when(text & ~F.col("heading") & ~F.col("noise") & ~option & (num != "") & ~rest.rlike(UNIT), num.cast("int")))
    n = n.withColumn("num", F.when(F.col("num").between(1, 50), F.col("num")))
    order = ["block_ord", "block_id"]
    plain = text & ~F.col("heading") & ~F.col("noise")
    n = n.select("doc_id", *order, "block_type", "noise", "heading", "num", "bottom", F.when(F.col("heading"), F.col("t")).alias("head"), (plain & ~option & F.col("t").rlike(FIGURE)).alias("figures"), (plain & option).alias("option"), (plain & (option | (count_options(F.col("t")) >= 2))).alias("options"))
    n = running(n, ["doc_id"], order, at=("sum", F.col("num").isNotNull().cast("int")), section=("last", F.col("head")))
    body = ~F.col("heading") & ~F.col("noise") & ~F.col("option") & (F.col("block_type") != "image")
    q = n.filter("at > 0").groupBy("doc_id", "at").agg(
        F.max("num").alias("q_index"), F.max("figures").alias("figure"), F.max("options").alias("has_options"),
        F.max_by(F.when(text, F.col("bottom")), F.when(body, F.struct(*order))).alias("ends"),
    )
    last = n.filter("block_type != 'image'").groupBy("doc_id").agg(F.max(F.struct(*order)).alias("last"), F.max("at").alias("asked"))
    before = q.select("doc_id", (F.col("at") + 1).alias("at"), "figure", "has_options", "ends")
    r = n.join(before, ["doc_id", "at"], "left").join(last, "doc_id", "left")
    image = F.col("block_type") == "image"
    back = F.coalesce("figure", F.lit(False)) | (F.coalesce("has_options", F.lit(False)) & F.coalesce(F.coalesce("bottom", F.lit(0.0)) < F.col("ends") + BELOW, F.lit(False)))
    seg = (
        F.when(image & (F.col("at") == 0), F.when(F.col("asked") > 0, 1).otherwise(0))
        .when(image & (F.struct(*order) < F.col("last")) & back, F.col("at") - 1)
        .when((F.col("at") == 0) & (F.col("block_type") == "equation") & (F.col("asked") > 0), 1)
        .otherwise(F.col("at"))
    )
    r = r.withColumn("seg", seg).filter("seg > 0 AND NOT noise AND NOT heading").select("doc_id", "block_id", "block_ord", "seg", "section", F.col("num").isNotNull().alias("opener"), "options")
    index = q.select("doc_id", F.col("at").alias("seg"), "q_index")
    return r.join(index, ["doc_id", "seg"], "left").join(b.select("block_id", "block_type", "t"), "block_id")


def block_questions(segments: DataFrame) -> DataFrame:
    """(doc_id, seg, q_index, section, stem, options, q_type, n_images): questions out of the blocks of segment_blocks.

    Option blocks become options, several in one block are parted; in experiment sections they stay in the text. Text that
    holds two or more labels is stem up to the first one and options from there.
    """
    opener = f"^({rx.D}{{1,3}})(?:{rx.DOT}|{rx.S})"
    x = F.when(F.col("opener"), X.strip(F.regexp_replace("t", opener, ""))).otherwise(F.col("t"))
    lab = F.coalesce(F.col("section"), F.lit("")).contains("实验") & F.col("t").rlike(rx.OPTION_START)
    r = segments.withColumn("x", x).withColumn("text", F.col("block_type") == "text").withColumn("many", (count_options(F.col("x")) >= 2) & ~lab).withColumn("single", F.col("x").rlike(rx.OPTION_START) & ~lab & ~F.col("many"))
    none = F.array().cast("array<string>")
    split = F.when(F.col("text") & F.col("many"), split_options(F.col("x")))
    r = r.withColumn("split", split).withColumn("opts", F.when(F.col("text") & F.col("many"), F.col("split.options")).when(F.col("text") & F.col("single"), F.array("x")).otherwise(none))
    r = r.withColumn("said", F.when(F.col("text") & F.col("many"), F.col("split.stem")).when(F.col("text") & ~F.col("single"), F.col("x")))
    g = r.groupBy("doc_id", "seg").agg(
        F.max("q_index").alias("q_index"), F.min_by("section", F.struct("block_ord", "block_id")).alias("section"), F.count_if(F.col("block_type") == "image").alias("n_images"),
        F.array_sort(F.collect_list(F.struct("block_ord", "block_id", "said", "opts"))).alias("rows"),
    )
    stem = X.strip(F.array_join(F.transform(F.filter("rows", lambda y: y["said"].isNotNull() & (y["said"] != "")), lambda y: y["said"]), "\n"))
    g = g.select("doc_id", "seg", "q_index", "section", stem.alias("stem"), F.flatten(F.transform("rows", lambda y: y["opts"])).alias("options"), "n_images")
    return g.withColumn("q_type", section_type(F.coalesce("section", F.lit("")), F.size("options"), F.col("stem")))


def attach_topics(questions: DataFrame, topic: str, role: str = "main", priority: int = 100) -> tuple[DataFrame, DataFrame]:
    """(topics, bridge): one topic per value of ``topic`` with its number of questions, and a bridge row per question. Null topics get none."""
    q = questions.filter(F.col(topic).isNotNull())
    topics = q.groupBy(F.col(topic).alias("title")).agg(F.count_distinct("question_id").alias("n_questions")).withColumn("topic_id", F.xxhash64("title"))
    bridge = q.select(F.xxhash64(topic).alias("topic_id"), "question_id", F.lit(role).alias("role"), F.lit(priority).alias("priority")).distinct()
    return topics, bridge


def ingest(pages: DataFrame, bank: DataFrame, similar: bool = False, words: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(new questions, summary) of page texts (doc_id, page_idx, text) against a bank with ``content_md``.

    The lenient segmentation, normalisation and deduplication in one plan; the latter is exact, and with ``similar`` drafts
    near to the bank or to an earlier draft are left out as well (see records.insert_similar) and counted in ``near_dup``.
    Documents without a question count as failed, those with questions but also pages without text as partial.
    """
    from quire.operators.records import insert_new, insert_similar

    lines = pages.select("doc_id", F.col("page_idx").alias("block_ord"), F.col("page_idx").cast("long").alias("block_id"), "page_idx", F.lit(0).alias("text_level"), F.posexplode(C.lines_of(F.col("text"))).alias("line_no", "line"))
    drafts = normalise(segment_lenient(lines))
    new, total = insert_new(bank, drafts, "content_md")
    near = pages.sparkSession.createDataFrame([], "near_dup bigint")
    if similar:
        new = materialise(new.withColumn("draft_id", F.struct("doc_id", "seg")))
        old = bank.select(F.struct(F.lit(None).cast("string").alias("doc_id"), F.xxhash64("content_md").alias("seg")).alias("draft_id"), "content_md")
        fate = materialise(insert_similar(old, new.select(F.struct("doc_id", F.col("seg").cast("bigint").alias("seg")).alias("draft_id"), "content_md"), "content_md", "draft_id", words, threshold).filter("reason = 'near_dup'").select(F.col("id.doc_id").alias("doc_id"), F.col("id.seg").alias("seg")))
        new, near = new.drop("draft_id").join(fate, ["doc_id", "seg"], "left_anti"), fate.agg(F.count("*").alias("near_dup"))
    files = drafts.select("doc_id", F.lit(1).alias("done"), F.lit(0).alias("gap")).unionByName(pages.select("doc_id", F.lit(0).alias("done"), F.when(F.coalesce(X.strip(F.col("text")), F.lit("")) == "", 1).otherwise(0).alias("gap"))).groupBy("doc_id").agg(F.max("done").alias("done"), F.max("gap").alias("gap"))
    count = files.agg(F.coalesce(F.sum("done"), F.lit(0)).alias("files_completed"), F.count_if((F.col("done") == 1) & (F.col("gap") == 1)).alias("files_partial"), F.count("*").alias("files_total"))
    parts, names = (total, near, count), []
    for p in parts:
        names += p.columns
    one = None
    for p in parts:
        row = p.select(*[(F.col(c) if c in p.columns else F.lit(0)).cast("bigint").alias(c) for c in names])
        one = row if one is None else one.unionByName(row)
    one = one.agg(*[F.sum(c).alias(c) for c in names]).withColumns({"inserted": F.col("inserted") - F.col("near_dup"), "files_failed": F.col("files_total") - F.col("files_completed")})
    return new, one
