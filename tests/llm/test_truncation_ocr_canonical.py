"""Cut-off text, scan noise and look-alike text: literal cases, brute force, odd inputs."""

from __future__ import annotations

import itertools
import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import canonical, ocr, truncation
from tests.conftest import SMALL

BLOCK = "block_id long, doc_id string, block_ord int, q_ord int, block_type string, content string, text_level int"
EXAM = "doc_id string, title string, source string"


def blocks(spark, rows):
    return spark.createDataFrame([(i, d, i, None, k, c, lv) for i, (d, k, c, lv) in enumerate(rows)], BLOCK)


def exams(spark, *rows):
    return spark.createDataFrame(list(rows), EXAM)


def test_strict_prefixes(spark):
    rnd = random.Random(1)
    values = ["".join(rnd.choice("ab甲") for _ in range(rnd.randint(0, 6))) for _ in range(300)] + [None, "", "x" * 100_000, "x" * 100_001]
    df = spark.createDataFrame([(v,) for v in values * 2], "v string")
    got = {r.value for r in truncation.strict_prefixes(df, "v", 7).collect()}
    known = {v for v in values if v}
    assert got == {a for a in known if any(b != a and b.startswith(a) for b in known)}
    assert truncation.strict_prefixes(df.limit(0), "v").count() == 0


def test_truncated(spark):
    long = "The quick brown pendulum rests on a smooth bench beside the lantern and then it"
    rows = [
        ("a", "text", long + " stops.", 0), ("a", "text", long, 0), ("a", "text", "Section A: heading without a stop of some length", 1),
        ("a", "text", "A. an option that has no full stop but is long enough", 0), ("a", "equation", "$$x=\\frac{1}{2", 0), ("a", "equation", "$$x$$", 0),
        ("a", "table", "<table><tr><td>1</td>", 0), ("a", "text", "已知弹簧的电阻是四十七千克而电容器的弹力大小是二十三米每秒钟�", 0),
        ("a", "text", "", 0), ("a", "text", None, 0), (None, "text", long + " wh", None), ("s", "text", long.replace("rests", "rests\n") + " ends.\n— 3 —\nThornwick Physics", 0),
        ("s", "text", "Thornwick Physics", 0), ("a", "image", "images/x", 0), ("a", "text", "A complete remark, and the rest goes the same way...", 0), ("a", "text", long + " at a very dist...", 0),
    ] + [("a", "text", f"Step {k} is done, and the rest goes the same way...", 0) for k in range(9)]
    b = blocks(spark, rows).withColumns({"source": F.lit("x"), "title": F.lit("y"), "tidy": F.lit(1), "h1": F.lit(2)})
    e = exams(spark, ("a", None, "web"), ("a", None, "web"), ("s", "Thornwick College Physics Paper 1", "phone_scan"), (None, "t", "u"))
    got = {r.block_id: r.evidence for r in truncation.truncated(b.unionByName(b), e).collect()}
    assert {k for k, v in got.items() if v} == {1, 4, 6, 7, 10, 15}
    assert (got[1], got[4], got[6], got[7], got[15]) == ("longer_copy", "markup", "markup", "broken_char", "ellipsis")
    s = {r.source: (r.n_blocks, r.n_cut) for r in truncation.truncation_by_source(b, e).collect()}
    assert s["phone_scan"] == (2, 0) and s[None] == (1, 1)
    assert truncation.truncated(b.limit(0), e).count() == 0 and truncation.truncated(b, e.limit(0)).filter("source IS NOT NULL").count() == 0


def test_lines():
    for line in ("— 4 —", "[5]", "7", "1 / 11", "p. 2", "Página 4 de 9", "Page 3 of 8", "第3页", "（第2页，共8页）", "·1·", "- 2 -", "第 6 页 共 10 页"):
        assert ocr.is_page_number(line), line
    for line in ("", "A. 5", "7 kg", "(1)", "page turner", "3.5"):
        assert not ocr.is_page_number(line), line
    title = "Instituto Montecillo, Prueba de Química 2033-1"
    assert ocr.is_running_header("Montecillo Química", title) and ocr.is_running_header("MONTECILLO QUÍMICA", title) and ocr.is_running_header(title, title)
    assert not ocr.is_running_header("El de", title) and not ocr.is_running_header("Montecillo", title) and not ocr.is_running_header("x", None)
    assert ocr.is_running_header("青岚物理", "青岚初春联考2031届物理试卷甲") and not ocr.is_running_header("物理", "青岚初春联考2031届物理试卷甲")
    assert ocr.join_lines(["the lon-", "gitud of", "it"]) == ("the longitud of it", True)
    assert ocr.join_lines(["光敏", "电阻 5 m", "ol"]) == ("光敏电阻 5 mol", False)


def test_costs():
    for seen, meant in (("elevat0r", "elevator"), ("tberefore", "therefore"), ("criicible", "crucible"), ("chmbs", "climbs"), ("therrnal", "thermal"), ("capac!tor", "capacitor")):
        assert ocr.confusion_cost(seen, meant) <= ocr.MOST
        assert set(ocr.deletes(seen)) & set(ocr.deletes(meant))
    assert ocr.confusion_cost("conveyo", "conveyor") > ocr.MOST


def scan_input(spark):
    clean = ["the heated crucible rests near the elevator floor.", "某同学测得线圈的质量分数是五，侧面紧贴木块。"] * 30
    noisy = ["the heatcd crucible rests near the ele-\nvator flo0r.\nPage 3 of 9\nThornwick Physics", "某同学测得钱圈的质\n最分数是五，侧面紧贴木块。\n第3页", "the heated crucible rests.", "", None, "x" * 50_000, "某同学测得钱圈的质最分数是五。"]
    b = blocks(spark, [("a", "text", c, 0) for c in clean] + [("s", "text", c, 0) for c in noisy] + [("s", "text", "第3页", 1), ("s", "equation", "第3页", 0)])
    return b, exams(spark, ("a", None, "web"), ("s", "Thornwick College Physics Paper 1", "phone_scan"), ("s", "Thornwick College Physics Paper 1", "phone_scan"))


def test_repair(spark):
    b, e = scan_input(spark)
    got = {r.block_id - 60: r for r in ocr.repair_scanned(b.withColumn("repaired", F.lit(1)).unionByName(b.withColumn("repaired", F.lit(1))), e).collect()}
    assert got[0].repaired == "the heated crucible rests near the elevator floor." and got[0].noise == ["broken_word", "misread", "page_number", "running_header"]
    assert got[1].repaired.startswith("某同学测得线圈的质量分数是五") and got[1].noise == ["misread", "page_number"]
    assert got[2].noise == [] and got[5].noise == [] and set(got) == {0, 1, 2, 5, 6}


def test_repair_by_join(spark):
    b, e = scan_input(spark)
    key = lambda df: sorted((r.block_id, r.repaired, tuple(r.noise)) for r in df.collect())
    assert key(ocr.repair_scanned(b, e)) == key(ocr.repair_scanned(b, e, max_broadcast_rows=-1))
    assert ocr.repair_scanned(b.limit(0), e).count() == 0 and ocr.repair_scanned(b, e.limit(0)).count() == 0


def test_nfc():
    rnd = random.Random(3)
    alpha = "aeoAEnN" + "̧̣́̈̊̂̄" + "éÅñệǖ" + "각각가 b"
    texts = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 9))) for _ in range(5000)]
    assert canonical.canonical_array(pa.array(texts)).to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


@pytest.mark.parametrize(("a", "b"), [("ＡＢ１，", "AB1,"), ("é", "é"), ("a​b­c", "abc"), ("a b", "a b"), ("сор", "cop"), ("Ω", "Ω"), ("金", "金"), ("⽔", "水"), ("ﬁ", "fi"), ("ⅴ", "v"), ("µ", "μ"), ("a‑b", "a-b"), ("　", " ")])
def test_same_look(a, b):
    x, y = canonical.canonical_array(pa.array([a, b])).to_pylist()
    assert x == y


@pytest.mark.parametrize(("a", "b"), [("m²", "m2"), ("①", "1"), ("a b", "a  b"), ("a\nb", "a b"), ("É", "E"), ("A", "a"), ("—", "-"), ("α", "a"), ("x₂", "x2"), ("…", "...")])
def test_different_look(a, b):
    x, y = canonical.canonical_array(pa.array([a, b])).to_pylist()
    assert x != y


def test_pairs(spark):
    rnd = random.Random(5)
    forms = ["ab", "ａb", "a​b", "ab c", "ab c", "AB", "", None, "é", "é", "z" * 60_000, "ｚ" + "z" * 59_999]
    rows = [(i, rnd.choice(forms)) for i in range(80)] + [(3, "ab")]
    df = spark.createDataFrame(rows, "block_id long, content string").withColumns({"c": F.lit(1), "t": F.lit(2), "id": F.lit(3)})
    got = {(r.block_id_a, r.block_id_b) for r in canonical.same_look_pairs(df, "block_id", "content").collect()}
    one = dict(zip(forms, canonical.canonical_array(pa.array(forms)).to_pylist()))
    want = {(min(a, b), max(a, b)) for (a, s), (b, t) in itertools.combinations(rows, 2) if s and t and s != t and one[s] == one[t] and a != b}
    assert got == want
    assert canonical.same_look_pairs(df.limit(0), "block_id", "content").count() == 0
    assert [r.canonical for r in canonical.canonical_text(df.filter("content IS NULL").limit(1), "content", keep=["block_id"]).collect()] in ([None], [])


def test_queries_small(spark):
    from quire.llm import queries

    for name, f in queries.queries().items():
        df = f(spark, SMALL)
        assert df.count() >= 0, name


def test_words_of_any_length(spark):
    long = "thermodynamischeuntersuchungsmethode"
    clean = f"the burn of it is in the {long} and of it. "
    ex = exams(spark, ("a", "T", "clean"), ("s", "U", "phone_scan"))
    rows = [("a", "text", clean * 40, 0), ("s", "text", f"the bum of it is ln the {long.replace('m', 'rn', 1)} and of it.", 0), ("s", "text", "the burn of it and ln", 0)]
    r = {x.block_id: (x.repaired, x.noise) for x in ocr.repair_scanned(blocks(spark, rows), ex).collect()}
    assert r[1] == (f"the burn of it is in the {long} and of it.", ["misread"])
    assert r[2] == ("the burn of it and ln", [])  # it may be the beginning of a word
    for seen, meant in (("bum", "burn"), ("cl", "d"), ("vvli1te", "white")):
        assert ocr.skeleton(seen) == ocr.skeleton(meant)
    assert all(ocr.skeleton(a) == ocr.skeleton(b) for a, b in ocr.PAIRS)


def test_page_lines_of_any_length():
    assert ocr.is_page_number("-" * 60 + " 12 " + "-" * 60) and ocr.is_page_number("第" + " " * 50_000 + "3 页") and not ocr.is_page_number("- " + " " * 50_000 + "x")


def test_limits_are_parameters(spark):
    rows = [("a", "text", "The rod rests on", 0), ("a", "text", "A short remark with no stop", 0), ("a", "text", "已知" + "弹簧" * 60 + " 2.", 0)]
    ex = exams(spark, ("a", "T", "web"))
    found = lambda **kw: {r.block_id for r in truncation.truncated(blocks(spark, rows), ex, **kw).filter("evidence IS NOT NULL").collect()}
    assert found() == {1, 2} and found(min_prose=10) == {0, 1, 2}
    copies = [("a", "text", f"Remark number {i} ends here; {'x' * (30 - len(str(i)))};", 0) for i in range(6)] + [("a", "text", f"Remark {i} goes on and on {'y' * (30 - len(str(i)))}", 0) for i in range(6)]
    kinds = lambda **kw: {r.evidence for r in truncation.truncated(blocks(spark, copies), ex, **kw).collect()}
    assert kinds() == {None, "open_end"} == kinds(limit_cases=99)


def test_classes(spark):
    df = spark.createDataFrame([(1, "a１"), (2, "a1"), (2, "a1"), (3, "a1"), (4, "b"), (5, "b"), (6, None), (7, "")], "id long, content string").withColumn("c1", F.lit(0))
    got = {tuple(r) for r in canonical.same_look_classes(df, "id", "content").collect()}
    assert got == {(1, 1, 3, 2), (2, 1, 3, 2), (3, 1, 3, 2)}
    assert canonical.same_look_classes(df.limit(0), "id", "content").count() == 0
