"""Operators on small fixtures: running aggregates, segmentation, layout, figures, records, block lists, sources, streams, sinks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import blocklist, fonts, layout, records, render, segment, spatial, store
from quire.operators.running import BUCKET, running
from quire.sources import files
from quire.streaming import streams

LINE = "doc_id string, block_ord int, block_id long, line_no int, page_idx int, text_level int, line string"


def lines(spark, *text):
    return spark.createDataFrame([("d", i, i, 0, 0, 0, t) for i, t in enumerate(text)], LINE)


def test_running_equals_window(spark):
    df = spark.range(3 * BUCKET).select((F.col("id") % 3).alias("p"), F.col("id").cast("int").alias("o"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, 1, 7), (None, 2, None)], "p long, o int, v long"))
    r = running(df, ["p"], ["o"], s=("sum", F.col("v")), m=("max", F.col("v")), last=("last", F.col("v")))
    w = W.partitionBy("p").orderBy("o")
    bad = r.withColumns({"s2": F.coalesce(F.sum("v").over(w), F.lit(0)), "m2": F.max("v").over(w), "l2": F.last("v", True).over(w)}).filter("NOT (s <=> s2 AND m <=> m2 AND last <=> l2)")
    assert bad.count() == 0 and r.count() == df.count()


def test_segmentation(spark):
    r = segment.segment_lenient(lines(spark, "卷头", "1. 甲", "(1) 一", "2．乙", "（1）二", "")).orderBy("seg").collect()
    assert [(x.source_qnum, x.content_md) for x in r] == [("01", "1. 甲\n(1) 一"), ("02", "2．乙\n（1）二")]
    assert segment.segment_lenient(lines(spark, "11．题", "①a", "②b", "12．题")).count() == 2
    assert segment.segment_lenient(lines(spark, "①a", "②b", "③c")).count() == 3
    assert segment.segment_lenient(lines(spark)).count() == 0


def test_markdown(spark):
    r = segment.segment_markdown(lines(spark, "## 一、选择题", "P3R", "1. 题干", "A. 一 B. 二 C. 三 D. 四", "## 三、实验题", "2. 用秒表", "更多")).orderBy("seg").collect()
    assert [(x.q_index, x.section, x.page, x.col_side, x.stem, len(x.options), x.q_type) for x in r] == [(1, "一、选择题", 3, 1, "题干", 4, "choice"), (2, "三、实验题", 3, 1, "用秒表\n更多", 0, "experiment")]


def test_normalise(spark):
    df = spark.createDataFrame([("1. ?????? ?????", "unknown", [" a", "a"])], "content_md string, q_type string, f array<string>")
    r = segment.normalise(df, paths="f").first()
    assert r.q_type in ("fill_blank", "calculation") and "A." not in r.content_md and "求" not in r.content_md and r.f == ["a"]


def test_layout(spark):
    assert layout.ranges_in("一、单项选择题：第1~7题\n二、多项选择题：8-10题") == {"single": (1, 7), "multi": (8, 10)}
    assert layout.ranges_in("第1至4题只有一项符合，第5～6题") .get("single") == (1, 4)
    assert layout.ranges_in("1-7题，8-10题") == {"single": (1, 7), "multi": (8, 10)}
    assert layout.ranges_in("") == {}
    p = spark.createDataFrame([("d", 0, "单项选择题 1-2 多项选择题 3-4"), ("d", 9, "单选题 5-6"), ("e", 0, None)], "doc_id string, page_idx int, text string")
    lay = layout.page_layout(p)
    assert {(r.kind, r.qnum) for r in lay.collect()} == {("single", 1), ("single", 2), ("multi", 3), ("multi", 4)}
    q = spark.createDataFrame([("d", 0, 1, None), ("d", 0, 3, None), ("d", 0, 9, "二、多选题"), ("d", 0, 10, None)], "doc_id string, source_page int, q_index int, section_title string")
    assert [r.multi_tag for r in layout.tag_multi_select(q, lay).orderBy("q_index").collect()] == [False, True, True, None]
    md = spark.createDataFrame([("d", "a\n P0L \nb"), ("e", "a\fb\fc"), ("f", "a\n\n\nb"), ("g", "a")], "doc_id string, md string")
    assert {r.doc_id: r["count"] for r in layout.split_pages(md).groupBy("doc_id").count().collect()} == {"d": 2, "e": 3, "f": 2, "g": 1}


def test_images(spark):
    b = spark.createDataFrame(
        [("d", 1, 0, 0, "text", "如图", [0.0, 0.0, 10.0, 100.0], None), ("d", 2, 1, 1, "text", "二", [0.0, 200.0, 10.0, 120.0], None), ("d", 3, 2, None, "image", "", [0.0, 130.0, 5.0, 180.0], "x/p.png"), ("d", 4, 3, None, "image", "", None, None)],
        "doc_id string, block_id long, block_ord int, q_ord int, block_type string, content string, bbox array<double>, img_path string",
    ).withColumn("page_idx", F.lit(0))
    assert {r.block_id: r.assigned for r in spatial.images_by_range(b).collect()} == {3: 1, 4: 1}
    assert {r.block_id: r.assigned for r in spatial.images_by_nearest(b).collect()} == {3: 1, 4: 0}
    i = spark.createDataFrame([("d", 0, "x/p.png", 0.0, 9.0, 0.0, 9.0), ("d", 0, "y/p.png", 1.0, 200.0, 0.0, 200.0), ("d", 0, "page_3.png", None, None, None, None)], "doc_id string, page_idx int, path string, y0 double, y1 double, x0 double, x1 double")
    assert {r.path: (r.block_id, r.how) for r in spatial.relink_images(i, b).collect()} == {"x/p.png": (3, "exact"), "y/p.png": (3, "name"), "page_3.png": (None, "orphan")}
    assert [(r.page_idx, r.path) for r in spatial.orphan_images(i, b).collect()] == [(2, "page_3.png")]
    assert {r.path for r in spatial.real_images(i).collect()} == {"y/p.png", "page_3.png"}
    assert spatial.real_images(i, 0).count() == 3
    assert {r.block_id: r.img_path for r in spatial.fill_image_paths(b, i).collect()}[3] == "x/p.png"


def test_sheets(spark):
    p = spark.createDataFrame([("d", 0, 1190.0), ("d", 1, None)], "doc_id string, page_idx int, width double")
    assert [(r.long_page, r.mark) for r in spatial.split_sheets(p).orderBy("page_idx", "long_page").collect()] == [(0, "P0L"), (1, "P0R"), (1, None)]
    a = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, q_index int")
    assert sorted(r.q_index for r in spatial.join_sides(a, a).collect()) == [1, 2, 3, 4]


def test_records(spark):
    q = spark.createDataFrame([(1, "A b"), (2, "ab"), (3, None), (4, "c"), (2, "ab")], "id long, t string")
    assert {r.id: r.kept_id for r in records.dedup_exact(q, "t", "id").collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    new, total = records.insert_new(q.filter("id = 1"), q, "t")
    assert {r.id for r in new.collect()} == {3, 4} and total.first().skipped == 3
    assert records.insert_new(q, q, "t")[0].count() == 0
    t = [(i, " ".join(f"w{j}" for j in range(40))) for i in (1, 2)] + [(3, " ".join(f"w{j}" for j in range(39)) + " zz"), (4, "short"), (5, None)]
    got = records.dedup_jaccard(spark.createDataFrame(t, "id long, t string"), "t", "id").collect()
    assert [(r.id_a, r.id_b) for r in got] == [(1, 3)] and abs(got[0].similarity - 35 / 37) < 1e-9
    j = spark.createDataFrame([(i, f"2024-01-01 00:0{i}:00") for i in range(4)], "id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {r.id for r in records.live_jobs(j, "ts", "id", F.lit("2024-01-01 00:30:00").cast("timestamp"), most=3).collect()} == {1, 2, 3}
    bank = spark.createDataFrame([("p", 1, "2024-01-01"), ("p", 2, "2024-02-01"), ("o", 3, "2024-02-01")], "source_paper string, source_qnum int, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    fetch = lambda since: [r.source_qnum for r in records.fetch_paper(bank, "p", F.lit(since).cast("timestamp")).collect()]
    assert fetch("2024-01-15") == [2] and fetch("2025-01-01") == [1, 2]


def test_jaccard_members(spark):
    same = " ".join(f"w{j}" for j in range(40))
    t = [(1, same), (2, same.upper()), (3, same + " zz"), (4, "13、" + same), (5, "13. " + same), (6, "short"), (7, "short"), (8, None)]
    got = records.jaccard_members(spark.createDataFrame(t, "id long, t string"), "t", "id").collect()
    assert {r.id: (r.kept_id, r.n_equal) for r in got} == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 2), 5: (4, 2), 6: (6, 1), 7: (7, 1), 8: (8, 1)} and len(got) == 8


def test_block_lists(spark):
    items = [{"type": "text", "text": "a", "text_level": 1}, {"type": "list", "list_items": ["x", {"text": "y"}, " "], "page_idx": 2, "bbox": [1, 2, 3, 4]}, {"type": "image", "img_path": "p", "text_detected": ["t"]}, {"type": "odd"}, {"type": "equation", "text": "e"}, {"type": "table", "html": "<t>"}]
    df = spark.createDataFrame([("d", json.dumps(items)), ("e", "not json"), ("f", None)], "doc_id string, items string")
    r = blocklist.parse_content_list(df, page_offset=1).orderBy("item_pos", "sub_pos").collect()
    assert [(x.block_type, x.content, x.page_idx) for x in r] == [("text", "a", 1), ("text", "x", 3), ("text", "y", 3), ("image", "t", 1), ("equation", "e", 1), ("table", "<t>", 1)]
    reply = 'Sure: {"blocks": [{"type": "text", "number": 1, "text": "q", "options": ["A. 1"]}, {"type": "image", "description": "fig"}]} done'
    r = blocklist.parse_model_reply(spark.createDataFrame([(1, reply), (2, "no"), (3, None)], "page int, reply string")).collect()
    assert [(x.page, x.block_type, x.content, len(x.options)) for x in r] == [(1, "text", "q", 1), (1, "image", "fig", 0)]


def test_render_and_sink(spark, tmp_path):
    q = spark.createDataFrame([("d", 1, 2, "b < c", "choice", True), ("d", 0, 1, None, "unknown", None), ("e", 0, None, "x", "experiment", None)], "doc_id string, q_ord int, q_index int, content_md string, q_type string, multi boolean")
    c = render.cards(q)
    r = {(x.doc_id, x.seq): x.html for x in c.collect()}
    assert "b &lt; c" in r["d", 2] and "多选" in r["d", 2] and 'id="q1"' in r["d", 1] and set(r) == {("d", 1), ("d", 2), ("e", 1)}
    render.write_exams(c, spark.createDataFrame([("d", "T & U"), ("e", None)], "doc_id string, title string"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out/doc_id=d/part=0").glob("*.txt"))
    assert text.index("T &amp; U") < text.index('id="q1"') < text.index('id="q2"') < text.index("<footer>")


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"12345")
    (tmp_path / "in/b.pdf").write_bytes(b"1" * 100)
    (tmp_path / "in/c.txt").write_text("x")
    (tmp_path / "in/m.md").write_text("a\r\nb", newline="")
    (tmp_path / "in/i.png").write_bytes(b"png")
    at = str(tmp_path / "in")
    assert {r.name for r in files.list_files(spark, at).collect()} == {"a.pdf", "b.pdf"}
    assert files.list_files(spark, at, modified_after="2999-01-01T00:00:00").count() == 0
    assert [r.length for r in files.read_binary(spark, at, max_bytes=50).collect()] == [5]
    assert [(r.doc_id, r.md) for r in files.read_markdown(spark, at).collect()] == [("m", "a\nb")]
    assert files.read_images(spark, at).first().name.startswith("mineru_")
    pages = files.read_pages(files.read_binary(spark, at), lambda data: [str(len(data))] if len(data) < 50 else 1 / 0)
    good, bad = files.quarantine(pages)
    assert [r.text for r in good.collect()] == ["5"] and [(r.path.rsplit("/", 1)[1], r.error.split(":")[0]) for r in bad.collect()] == [("b.pdf", "ZeroDivisionError")]

    class Missing(files.Extractor):
        def is_available(self):
            return False

    assert files.read_pages(files.read_binary(spark, at), Missing()).count() == 0
    writable, free = files.output_state(spark, str(tmp_path / "new/folder"))
    assert writable and (free is None or free > 0)
    names = spark.createDataFrame([("a.pdf", 5, None), ("b.txt", 5, None), (None, None, None), ("c.PDF", 1 << 30, None), ("d.pdf", 1, True)], "path string, length long, encrypted boolean")
    fate = lambda **kw: [r.error for r in records.preflight(names, **kw).collect()]
    assert fate() == [None, "NOT_A_PDF", "FILE_NOT_FOUND", "FILE_TOO_LARGE", "PDF_ENCRYPTED"]
    assert fate(writable=False)[0] == "OUTPUT_NOT_WRITABLE" and fate(free_bytes=1)[0] == "DISK_FULL" and fate(free_bytes=1 << 40)[0] is None
    assert files.incomplete(files.list_files(spark, at), spark.createDataFrame([("a.pdf",)], "name string"), F.current_timestamp()).count() == 1
    (tmp_path / "o.json").write_text('{"mode": 3, "mineru_token": "t", "x": 1}')
    assert files.load_options(tmp_path / "o.json") == {"mineru_token": "t", "output_dir": None, "last_check_ts": None, "mode": None}
    assert files.engine_mode(files.load_options(tmp_path / "o.json")) == "precision" and files.engine_mode(files.load_options(tmp_path / "none")) == "flash"


def test_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"1")
    seen: list[str] = []
    take = lambda df, _: seen.extend(r.path.rsplit("/", 1)[1] for r in df.select("path").collect())
    for name in ("b.pdf", None):
        streams.drain(streams.inbox_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"), take)
        if name:
            (tmp_path / "in" / name).write_bytes(b"2")
    assert seen == ["a.pdf", "b.pdf"]


def test_job_states(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 03:00:00"), (None, "2024-01-01 00:00:00"), ("c", None)], "job string, at string")
    df.select("job", F.to_timestamp("at").alias("at")).write.parquet(str(tmp_path / "in"))
    r = streams.collect_stream(spark, streams.job_states(streams.table_stream(spark, str(tmp_path / "in")), "at", "job")).collect()
    assert {(x.job, x.n) for x in r if x.state == "expired"} == {("a", 2)} and {x.job for x in r if x.state == "alive"} == {"a", "b"}
    q = streams.inbox_stream(spark, str(tmp_path / "in"), "*.parquet").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert streams.progress(q)["state"] == "done"


def test_core_stands_alone():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "quire"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(?:from|import) quire\.llm|^\s*from quire import .*\bllm\b", p.read_text(), re.M), p


def page(spark, *rows):
    cols = "block_id long, doc_id string, block_ord int, q_ord int, block_type string, content string, page_idx int, text_level int, col_side int, bbox array<double>"
    return spark.createDataFrame([(i, "d", i, None, k, c, 0, lv, -1, box) for i, (k, c, lv, box) in enumerate(rows)], cols)


def test_block_segmentation(spark):
    rows = [
        ("equation", "E=mc", None, None), ("image", "", None, None), ("text", "一、选择题", 1, None), ("text", "1. 求 E，如图", 0, None), ("image", "", 0, None), ("text", "2. 题", 0, None), ("image", "", 0, None), ("text", "3. 题", 0, None),
        ("text", "4. kg 以上", 0, None), ("text", "A. 选项", 0, None), ("text", "ZZZZ ?", 0, None), ("image", "", 0, None),
    ]
    b = page(spark, *rows)
    got = {r.block_id: (r.seg, r.q_index) for r in segment.segment_blocks(b.unionByName(b)).collect()}
    # the figure in question 2 goes back to question 1, which speaks of one; the last one stays, as nothing follows
    assert got == {0: (1, 1), 1: (1, 1), 3: (1, 1), 4: (1, 1), 5: (2, 2), 6: (1, 1), 7: (3, 3), 8: (3, 3), 9: (3, 3), 11: (3, 3)}
    assert segment.segment_blocks(b.limit(0)).count() == 0 and segment.block_questions(segment.segment_blocks(b.limit(0))).count() == 0


def test_block_rules(spark):
    number = lambda *texts: [r.q_index for r in segment.segment_blocks(page(spark, ("text", "1. 题", 0, None), *(("text", x, 0, None) for x in texts))).orderBy("block_ord").collect()]
    assert number("5. 3 m/s", "6. 3 b题", "{{x}}", "7. J/s", "8. J 是") == [1, 1, 6, 6, 6]
    # a figure just below the options of the question before
    box = lambda y0, y1: [0.0, y0, 9.0, y1]
    rows = lambda y: page(spark, ("text", "1. 题", 0, box(0.0, 10.0)), ("text", "A. 一 B. 二", 0, box(10.0, 20.0)), ("text", "2. 题", 0, box(60.0, 70.0)), ("image", "", 0, box(20.0, y)), ("text", "完", 0, None))
    image = lambda y: next(r.seg for r in segment.segment_blocks(rows(y)).collect() if r.block_id == 3)
    assert image(50.0) == 1 and image(90.0) == 2


def test_block_questions(spark):
    rows = [
        ("text", "一、选择题", 1, None), ("text", "1. 下列正确的是（ ）\nA. 甲 B. 乙\nC. 丙", 0, None), ("text", "D. 丁", 0, None), ("image", "", 0, None),
        ("text", "三、实验题", 1, None), ("text", "2. 用秒表测量", 0, None), ("text", "A. 保留在题中", 0, None), ("text", "四、填空题", 1, None), ("text", "3. 空", 0, None),
    ]
    r = segment.block_questions(segment.segment_blocks(page(spark, *rows))).orderBy("seg").collect()
    assert [(x.q_index, x.section, x.options, x.q_type, x.n_images) for x in r] == [
        (1, "一、选择题", ["A. 甲", "B. 乙", "C. 丙", "D. 丁"], "choice", 1), (2, "三、实验题", [], "experiment", 0), (3, "四、填空题", [], "fill_blank", 0),
    ]
    assert r[0].stem == "下列正确的是（ ）" and r[1].stem == "用秒表测量\nA. 保留在题中"


def test_markdown_late_openers_and_options(spark):
    r = segment.segment_markdown(lines(spark, "A. 前 9.不算", "1. 题一（ ）A．甲 B．乙 C．丙", "还有", "2. 题二", "A. 甲", "D. 丁 3.题干三在此", "接着", "B. 乙 77.不是题", "4．答（ ）没有")).orderBy("seg").collect()
    assert [(x.q_index, x.stem, x.options) for x in r] == [
        (1, "题一\n还有", ["A．甲", "B．乙", "C．丙"]), (2, "题二", ["A. 甲", "D. 丁"]), (3, "题干三在此\n接着", ["B. 乙 77.不是题"]), (4, "答（ ）没有", []),
    ]


def test_images_by_column(spark):
    rows = [(1, "d", 0, 1, "text", 0, 0.0), (2, "d", 1, 2, "text", 1, 5.0), (3, "d", 2, None, "image", 0, 9.0), (4, "d", 3, None, "image", 1, 9.0), (5, "d", 4, None, "image", -1, 3.0), (6, "e", 0, None, "image", 1, 3.0)]
    b = spark.createDataFrame([(i, d, o, q, k, 0, c, [0.0, y, 1.0, y + 1]) for i, d, o, q, k, c, y in rows], "block_id long, doc_id string, block_ord int, q_ord int, block_type string, page_idx int, col_side int, bbox array<double>")
    assert {r.block_id: r.assigned for r in spatial.images_by_range(b).collect()} == {3: 1, 4: 2, 5: 1, 6: None}


def test_layout_headings(spark):
    assert layout.ranges_in("二、多项选择题（8-10题）\n一、单项选择题 1--7 题") == {"multi": (8, 10), "single": (1, 7)}
    assert layout.ranges_in("  2、多选 3~5\n以上为多选") == {"multi": (3, 5)} and layout.ranges_in("本卷不含多选 3~5") == {}
    assert layout.ranges_in("单选题 0-7 单选题 9-60") == {} and layout.ranges_in("多选题" + "。" * 260 + "3-4") == {}


def test_insert_similar(spark):
    w = [f"w{i}" for i in range(40)]
    bank = spark.createDataFrame([(1, " ".join(w))], "id long, text string")
    drafts = spark.createDataFrame([(1, "  ".join(w).upper()), (2, " ".join([*w, "more"])), (3, "quite another text of several words"), (4, "quite another text of several words"), (5, None), (6, "")], "id long, text string").withColumn("s", F.lit(1))
    r = {x.id: (x.is_new, x.reason, round(x.similarity, 3), x.match_id) for x in records.insert_similar(bank, drafts, "text", "id").collect()}
    assert r == {1: (False, "exact", 1.0, 1), 2: (False, "near_dup", round(36 / 37, 3), 1), 3: (True, "new", 0.0, None), 4: (False, "exact", 1.0, 3), 5: (True, "new", 0.0, None), 6: (False, "exact", 1.0, 5)}
    assert records.insert_similar(bank, drafts.limit(0), "text", "id").count() == 0 and records.insert_similar(bank.limit(0), drafts, "text", "id").filter("is_new").count() == 3


def test_assemble(spark):
    rows = [("a", i, f"K{i}") for i in range(1, 6)] + [("b", 1, "K1"), ("b", 2, None), ("c", 1, None)]
    q = spark.createDataFrame(rows, "doc_id string, q_index int, bucket string")
    parts = lambda df: {(x.doc_id, x.q_index): x.section for x in df.collect()}
    assert parts(render.assemble(q)) == {**{("a", i): "_all" for i in range(1, 6)}, ("b", 1): "K1", ("b", 2): "_rest", ("c", 1): "_all"}
    totals = spark.createDataFrame([("a", 6)], "doc_id string, total int")
    assert parts(render.assemble(q, totals))["a", 3] == "K3"


def test_parts_of_large_exams(spark, tmp_path):
    q = spark.range(7).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("q_ord"), (F.col("id") % 2).cast("int").alias("q_index"), F.lit("x").alias("content_md"), F.lit("choice").alias("q_type"), F.lit(None).cast("boolean").alias("multi"))
    c = render.cards(q)
    assert [r.html.split("<b>")[1][:2] for r in c.orderBy("seg" if "seg" in c.columns else "seq").collect()] == ["00"] * 4 + ["01"] * 3
    render.write_exams(c, spark.createDataFrame([("d", "T")], "doc_id string, title string"), str(tmp_path / "out"), per_part=3)
    part = lambda k: "".join(p.read_text() for p in (tmp_path / f"out/doc_id=d/part={k}").glob("*.txt"))
    assert [part(k).count("<section") for k in range(3)] == [3, 3, 1] and all("<title>T" in part(k) and "<footer>" in part(k) for k in range(3))


def test_store(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, text string, n int")
    assert store.versions(spark, at) == [] and store.commit(df, at) == 1
    new = spark.createDataFrame([(1, "A"), (9, "Z")], "id long, text string").withColumn("unknown", F.lit(1))
    assert store.update_batch(spark, at, new, "id") == 1
    rows = lambda: sorted(map(tuple, store.current(spark, at).collect()))
    assert rows() == [(1, "A", 0), (2, "b", 0)] and store.versions(spark, at) == [1, 2]
    for bad in ([(1, "x"), (None, "y")], [(1, "x"), (1, "y")], [(1, "x"), (2, "")], [(7, "x")]):
        assert store.update_batch(spark, at, spark.createDataFrame(bad, "id long, text string"), "id", F.length("text") > 0) == 0
    assert rows() == [(1, "A", 0), (2, "b", 0)]
    log = str(tmp_path / "log")
    done = store.compose(spark, at, {"topic": df}, lambda out: df.select("text").write.text(out), log, topic="x")
    assert done == {"topic": 1}
    try:
        store.compose(spark, at, {"topic": df.limit(1), "bridge": df}, lambda _: 1 / 0, log, topic="x")
        raise AssertionError("the failure was swallowed")
    except ZeroDivisionError:
        pass
    assert store.current(spark, f"{at}/topic").count() == 2 and store.versions(spark, f"{at}/bridge") == []
    assert sorted(r.status for r in spark.read.parquet(log).collect()) == ["done", "failed"]
    store.append_log(spark, "nowhere://x", a=1)


def test_text_dict(spark):
    d = {"blocks": [{"type": 0, "lines": [{"bbox": [1, 2, 3, 4], "spans": [{"size": 10.5, "text": "1."}, {"size": 9, "text": " 题"}]}, {"spans": []}]}, {"type": 1}, {"lines": [{"spans": [{"size": 11, "text": "x" * 99}]}]}]}
    p = spark.createDataFrame([("d", 0, json.dumps(d)), ("e", 0, "no"), ("f", 0, None)], "doc_id string, page_idx int, text_dict string")
    r = fonts.text_dict_lines(p)
    assert [(x.block_ord, x.line_no, x.line[:3], x.size, x.y) for x in r.orderBy("block_ord").collect()] == [(0, 0, "1. ", 10.5, 2.0), (2, 0, "xxx", 11.0, None)]
    assert [(x.qnum, x.shown) for x in fonts.font_qnums(r).collect()] == [(1, "1. 题")]
    assert fonts.font_qnums(r, fonts.QNumRule(body_size=(11.0, 12.0))).count() == 0


def test_page_images(spark):
    i = spark.createDataFrame([("d", 0, "b", 5.0, 6.0, 1.0, 2.0), ("d", 0, "a", 9.0, 9.5, None, 2.0), ("d", 1, "c", 1.0, 2.0, 3.0, 4.0), ("d", 1, None, 1.0, 2.0, 3.0, 4.0)], "doc_id string, page_idx int, path string, y0 double, y1 double, x0 double, x1 double")
    assert {(r.page_idx, r.col_side, r.img_path, r.bbox is None) for r in spatial.embedded_images(i.unionByName(i)).collect()} == {(0, 0, "b", False), (0, 0, "a", True), (1, 1, "c", False)}
    m = spatial.page_map(i)
    assert m.first().pages == {0: ["b", "a"], 1: ["c"]}
    assert m.withColumn("p", F.lit(7)).select(F.size(spatial.paths_on("pages", "p")).alias("n")).first().n == 0
    b = spark.createDataFrame([("d", 3, "image", "b")], "doc_id string, page_idx int, block_type string, img_path string")
    assert {r.page_idx for r in spatial.figure_pages(i, b).collect()} == {0, 1, 3}


def test_shared_folder_is_asked_for(spark, monkeypatch):
    from quire import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(Session())


def test_ingest_and_topics(spark):
    p = spark.createDataFrame([("a", 0, "头\n1. 题一\n2. 题二"), ("b", 0, "无题"), ("c", 0, "1. 题一"), ("d", 0, None)], "doc_id string, page_idx int, text string")
    bank = spark.createDataFrame([("1.题一",)], "content_md string")
    new, total = segment.ingest(p, bank)
    r = total.first()
    assert [x.content_md for x in new.collect()] == ["2. 题二"] and (r.drafts, r.inserted, r.skipped, r.files_total, r.files_failed, r.files_partial, r.near_dup) == (3, 1, 2, 4, 2, 0, 0)
    words = "一个较长的题目其中有许多字用来比较相似的程度大概三十个字左右再加一些"
    p = spark.createDataFrame([("a", 0, f"1. {words}"), ("a", 1, " "), ("b", 0, f"1. {words}啊")], "doc_id string, page_idx int, text string")
    new, total = segment.ingest(p, bank.limit(0), similar=True)
    r = total.first()
    assert new.count() == 1 and (r.drafts, r.inserted, r.near_dup, r.files_partial) == (2, 1, 1, 1)
    q = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "question_id long, s string")
    topics, bridge = segment.attach_topics(q, "s")
    assert topics.first().n_questions == 2 and bridge.count() == 2


def test_release(spark):
    from quire.session import materialise, release

    df = materialise(spark.range(3))
    assert df.count() == 3 and release(spark) >= 1 and release(spark) == 0


def test_insert_similar_shuffles_in_proportion(spark):
    """Bytes shuffled by a query of some 100 KB of text: the shingles themselves aren't shuffled."""
    import random

    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randrange(900)) for _ in range(120)) for _ in range(100)]
    rows = [(i, x) for i, x in enumerate(texts + [f"{x} more" for x in texts[:10]])]
    df = spark.createDataFrame(rows, "id long, text string")
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))
    before = sum(x.shuffleWriteBytes() for x in stages())
    got = {r.id: (r.reason, r.match_id) for r in records.insert_similar(df.filter("id < 100"), df.filter("id >= 95"), "text", "id").collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got == {i: ("exact", i) if i < 100 else ("near_dup", i - 100) for i in range(95, 110)}
    assert sum(x.shuffleWriteBytes() for x in stages()) - before < 4 * sum(len(x) for _, x in rows)
