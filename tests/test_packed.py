"""Packed values against literal cases and a plain splitter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators.packed import cut_elements, split_batch, split_packed


def split(*rows, only_packed=False):
    b = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(list(rows), pa.list_(pa.string()))], names=["id", "o"])
    out = split_batch(b, ["id"], "o", only_packed, 3).to_pylist()
    return [[r["value"] for r in out if r["id"] == i] for i in range(len(rows))], out


CASES = {
    "A、甲\tB、乙\tC、丙": ["A、甲", "B、乙", "C、丙"],
    "（A）甲 / （B）56.3 cm\n（C）乙  （D）丙": ["（A）甲", "（B）56.3 cm", "（C）乙", "（D）丙"],
    '["30 mL", "a; b", "c"]': ["30 mL", "a; b", "c"],
    '["x", "the \\"cold\\" one"]': ["x", 'the "cold" one'],
    '"punto (69, 70)" "el ""frío""" "sube, luego baja"': ["punto (69, 70)", 'el "frío"', "sube, luego baja"],
    "40 Pa||stops|||v| < 23.66 m/s||flux||": ["40 Pa", "stops", "|v| < 23.66 m/s", "flux"],
    "rises, then falls|doubles|it heats; nothing else": ["rises, then falls", "doubles", "it heats; nothing else"],
    "x；y；z；": ["x", "y", "z"],
    "升温；但滑块不动": ["升温；但滑块不动"],
    "A、B两球的压强相等": ["A、B两球的压强相等"],
    "one # two": ["one", "two"],
    "'a', b, c": ["a", "b", "c"],
    "": [],
    "   ": [],
}


def test_cases():
    got, _ = split(*[[x] for x in CASES])
    assert got == list(CASES.values())


def test_positions_and_nulls():
    got, rows = split(["A. 1", "B. 2；C. 3", None, "D. 4"], None, [], ["x", "y", "z"])
    assert got == [["A. 1", "B. 2", "C. 3", "D. 4"], [], [], ["x", "y", "z"]]
    assert [r["val_pos"] for r in rows if r["id"] == 0] == [1, 2, 3, 4]
    assert [r["elem_pos"] for r in rows if r["id"] == 0] == [1, 2, 2, 4]
    assert {r["is_packed"] for r in rows if r["id"] == 3} == {False}
    assert split(["A. 1", "B. 2"], ["a|b"], only_packed=True)[0] == [[], ["a", "b"]]


def test_long_value():
    parts = ["甲" * 100_000, "b" * 200_000, "c"]
    assert split(["\t".join(parts)])[0] == [parts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text("ab甲乙 é", max_size=5), min_size=1, max_size=6), min_size=1, max_size=5), st.sampled_from(["\t", "\n", "#", "||"]))
def test_plain_delimiters(rows, delim):
    got, _ = split(*[[delim.join(r)] for r in rows])
    want = [[p.strip() for p in r if p.strip()] for r in rows]
    blanks = [any("  " in p.strip() for p in r) for r in rows]  # runs of blanks delimit too
    assert all(g == w for g, w, b in zip(got, want, blanks) if not b or len(w) > 3)


def test_spark(spark):
    df = spark.createDataFrame([(1, ["a|b|c"], "x"), (1, ["a|b|c"], "y"), (2, None, "z")], "id long, o array<string>, value string")
    assert split_packed(df, ["id"], "o").count() == 6
    assert split_packed(df.limit(0), ["id"], "o").count() == 0


def test_labels_of_every_kind():
    cut = lambda x: cut_elements(pa.array([x]), np.array([True]))[1].to_pylist()
    many = [f"{chr(65 + i)}. v{i}" for i in range(26)]
    assert cut(" ".join(many)) == many and cut("; ".join(many[:10])) == many[:10]
    assert cut("a) one b) two") == ["a) one", "b) two"] and cut("a. only") == ["a. only"]
    numbers = [f"{i}. v" for i in range(1, 121)]
    assert cut(" ".join(numbers)) == numbers and cut("(1) x (2) y") == ["(1) x", "(2) y"]
    for whole in ("1.5 m/s", "10:30 11:30", "9. x 10. y", "2. x 3. y"):
        assert cut(whole) == [whole]
    assert cut("A. x B. y " * 3000)[0] == "A. x"
