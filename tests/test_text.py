"""Literal cases of the text functions, classifiers and option splitting."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import classify as C
from quire.functions import options as P
from quire.functions import text as X
from quire.functions.choices import parse_choices
from quire.operators.segment import distinct_paths, figure_quota, reattach_prose


def run(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def one(spark, f, value):
    return run(spark, f, value)[0]


@pytest.mark.parametrize("f", [X.ocr_punct, X.clean_block, X.ocr_noise, X.tail_trim, X.strip_tags, X.escape_html, X.collapse_blanks, X.wrap_latex, X.strip_sections, P.split_inline_options, reattach_prose])
def test_null_and_empty(spark, f):
    assert run(spark, f, None, "") == [None, ""]


def test_marks(spark):
    assert run(spark, X.ocr_punct, "是??的", "对?!吗", "a???", "好!", "a!=b!?") == ["是？的", "对！吗", "a?？", "好！", "a！=b!?"]
    assert one(spark, X.clean_block, "　a    b ") == "a  b"


def test_noise(spark):
    assert one(spark, X.ocr_noise, "压强 1024 Pa") == "压强 1024 Pa"
    assert "0000000" not in one(spark, X.ocr_noise, "速度 00000000000 O0 大")


def test_tail(spark):
    assert run(spark, X.tail_trim, "小球…求: x", "求：（1）速度", "求：物体的加速度大小", "无") == ["小球…求:", "求：（1）速度", "求：物体的加速度大小", "无"]


def test_tags_latex_blanks(spark):
    assert one(spark, X.strip_tags, "<b>a</b><br/>c") == "ac"
    assert one(spark, X.escape_html, "a<b & c>d") == "a&lt;b &amp; c&gt;d"
    assert one(spark, X.wrap_latex, "角\\theta 与 $\\alpha$ 和 $$\\beta$$") == "角$\\theta$ 与 $\\alpha$ 和 $$\\beta$$"
    assert one(spark, X.wrap_latex, "\\frac \\sqrt{2}") == "\\frac $\\sqrt{2}$"
    assert one(spark, X.collapse_blanks, "a  b \n<pre>x   y</pre>  z") == "a b\n<pre>x   y</pre> z"
    assert one(spark, X.circled_macro, "$\\textcircled{3}$") == '<span class="circled">3</span>'
    assert one(spark, X.strip_sections, "一、选择题\n1. 题\n第Ⅱ卷") == "1. 题"


def test_names(spark):
    assert run(spark, X.stem, "/a/b.c.pdf", "x", ".hid") == ["b.c", "x", ".hid"]
    assert run(spark, X.suffix, "/a/b.PDF", "x") == [".pdf", ""]
    assert run(spark, lambda c: X.pad_qnum(c.cast("int")), "1", "12", "123") == ["01", "12", "123"]


def test_numbers(spark):
    ok = ["（1）", "(2)", "①", "⑩", "第 12 题", "T1.", "Q2.", "题3.", "12．", "5、"]
    assert run(spark, C.union_qnum, *ok) == [1, 2, 1, 10, 12, 1, 2, 3, 12, 5]
    bad = ["0.05 g", "1.14 mol/L", "0.848 g·cm", "m=0.1kg", "99.", "2026 年"]
    assert run(spark, C.union_qnum, *bad) == [None] * 6
    assert run(spark, C.top_qnum, "6.2024 年12 月", "1.5m", "9.8m/s", "0.05 g", "3.14 rad", "(1) x", "１2．题") == [6, None, None, None, None, None, 12]
    assert run(spark, C.sub_qnum, "（3）求", "(51)", "3)") == [3, None, None]


def test_types(spark):
    t = lambda c: C.question_type(c, F.lit("unknown"))
    cases = {
        "1. 题\nA. 5\nB. 6\nC. 7\nD. 8": "choice",
        "求:\n(1) a\n(2) b": "calculation",
        "(1) a (2) b": "calculation",
        "质量为___": "fill_blank",
        "利用单摆测重力加速度，用游标卡尺": "experiment",
        "（18分）一物体…求速度": "calculation",
        "如图甲所示的物块": "fill_blank",
        "甲\n乙\n丙\n丁": "fill_blank",
        "": "unknown",
    }
    assert run(spark, t, *cases) == list(cases.values())


def test_real_options(spark):
    df = spark.createDataFrame([(0, ["A. 1", "B. 2", "C. 3", "D. 4"]), (1, ["A. 1"]), (2, ["A. 1", "C. 2", "B. 3", "D. 4"]), (3, None), (4, ["A. 1", None, "C. 2"])], "i int, o array<string>")
    assert [r.x for r in df.select("i", P.are_real_options(F.col("o")).alias("x")).orderBy("i").collect()] == [True, False, False, False, False]


def test_inline_options(spark):
    assert one(spark, P.split_inline_options, "A. 5 m/s B. 10 m/s C. 15 m/s D. 20 m/s") == "A. 5 m/s\nB. 10 m/s\nC. 15 m/s\nD. 20 m/s"
    assert one(spark, P.split_inline_options, "求末速度 A. $\\frac{1}{2}$ B. $\\frac{1}{3}$ C. 1 D. 2") == "求末速度\nA. $\\frac{1}{2}$\nB. $\\frac{1}{3}$\nC. 1\nD. 2"
    assert one(spark, P.split_inline_options, "A. only one") == "A. only one"


def test_split_options(spark):
    r = one(spark, P.split_options, "题干 $A 、 B$ A. $x$ 米 B. 二 C. 三")
    assert (r.stem, r.options) == ("题干 $A 、 B$", ["A. $x$ 米", "B. 二", "C. 三"])
    r = one(spark, lambda c: P.split_options(c, keep_tail=False), "题 A. $x$ 米 B. 二")
    assert r.options == ["A. $x$", "B. 二"]
    assert one(spark, P.count_options, "A. 1 $B. 2$ C.") == 2


def test_reattach(spark):
    assert one(spark, reattach_prose, "1. 题\nA. 甲物体\n速度为 5 m/s，向东\nB. 乙物体\n速度为 6 m/s，向西") == "1. 题\nA. 甲物体速度为 5 m/s，向东\nB. 乙物体\n速度为 6 m/s，向西"
    got = one(spark, reattach_prose, "题干在此\n则甲的速度为 5 m/s\nA. 甲\nB. 乙")
    assert got == "题干在此\nA. 甲则甲的速度为 5 m/s\nB. 乙"
    assert one(spark, lambda c: reattach_prose(c, flush=False), "A. 甲\n速度为 5 m/s，向东") == "A. 甲"


def test_choices(spark):
    got = one(spark, parse_choices, "<p>1. 题</p>\nA.一 B.二\nC.三\n续\nD.")
    assert [(o.letter, o.text.strip(), o.bare) for o in got] == [(None, "1. 题", False), ("A", "一", False), ("B", "二", False), ("C", "三续", False), ("D", "", True)]
    assert len(one(spark, parse_choices, "A.CO₂ → B.xx")) == 1


def test_equation_and_mode(spark):
    assert run(spark, C.is_complex_equation, "$2H_2+O_2 → 2H_2O$", "已知 $x$ 是一个很长的题目描述文字", "$\\mathrm{H}$ $\\mathrm{O}$") == [True, False, True]
    assert run(spark, C.answer_mode, "回答下列问题", "(1)a(2)b", "A. x") == ["free_response", "free_response", "choice"]


def test_quota_and_paths(spark):
    df = spark.createDataFrame([(["如图 1", "无", "如图（甲）"], [["a", "b"], [], ["c", "d", "e"]])], "t array<string>, i array<array<string>>")
    assert df.select(figure_quota(F.col("t"), F.col("i")).alias("k")).first().k == [["a"], ["b"], ["c"]]
    df = spark.createDataFrame([(["如图", None], [["a", "b"], None])], "t array<string>, i array<array<string>>")
    assert df.select(figure_quota(F.col("t"), F.col("i")).alias("k")).first().k == [["a", "b"], []]  # no label, no limit
    df = spark.createDataFrame([([" a", None, "b", "a", " "],), (None,)], "p array<string>")
    assert [r.x for r in df.select(distinct_paths(F.col("p")).alias("x")).collect()] == [["a", "b"], []]


def test_semver(spark):
    from quire.operators.records import is_newer, throttled

    df = spark.createDataFrame([("1.10.0", "1.9.0"), ("1.2", "1.0.0"), ("1.0.0-beta", "1.0.0")], "a string, b string")
    assert [r.x for r in df.select(is_newer(F.col("a"), F.col("b")).alias("x")).collect()] == [True, None, False]
    df = spark.createDataFrame([("2024-01-01 11:59:00", False), ("2023-12-31 11:00:00", False), ("garbage", False), ("2024-01-01 11:59:00", True), (None, None)], "a string, f boolean")
    assert [r.x for r in df.select(throttled(F.col("a"), F.lit("2024-01-01 12:00:00").cast("timestamp"), F.col("f")).alias("x")).collect()] == [True, False, False, False, False]
