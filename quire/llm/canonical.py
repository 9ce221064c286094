"""Visually identical text -> one stored form.

The text column of an Arrow batch becomes one flat code-point array. A lookup
table gathers, per code point, its replacement (none, one or several code
points), expansion offsets place the results, combining marks are put in
canonical order and composed with their base by table search. No call per row.

What counts as the same look, and so ends in one form:

* canonically equivalent sequences (Unicode NFC is the output form);
* full-width / half-width forms; compatibility ideographs and radicals used as
  ideographs; ligatures, digraphs and Roman-numeral characters against the
  letters they show; the micro sign against mu;
* blanks of any width (their number is kept); hyphen characters;
* look-alike letters of other scripts against their Latin letter;
* default-ignorable characters (zero-width, soft hyphen, bidi marks, variation
  selectors) against nothing.

Case, accents, super- and subscripts, circled digits, line ends, tabs and the
number of blanks stay different.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.arrowtext import codepoints, owners, to_strings
from quire.session import materialise

# Letters of other scripts (left) that look like a Latin letter (right).
LOOKALIKES = (
    "а=a е=e о=o р=p с=c у=y х=x ѕ=s і=i ј=j һ=h ԁ=d ԛ=q ԝ=w ӏ=l ѵ=v ԍ=G "
    "А=A В=B Е=E К=K М=M Н=H О=O Р=P С=C Т=T У=Y Х=X Ѕ=S І=I Ј=J Ԛ=Q Ԝ=W Ү=Y Ӏ=I Ԍ=G Ѵ=V "
    "Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X ο=o ν=v ϲ=c ϳ=j Ϝ=F Ϲ=C Ϳ=J "
    "օ=o հ=h ո=n ս=u զ=q ց=g ɑ=a ɡ=g ꞓ=c ᴏ=o ᴠ=v ᴡ=w ᴢ=z ꜱ=s ᴄ=c ‐=- ‑=- ﹣=- ˗=-"
)
# Ranges of characters that show nothing.
IGNORABLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
#: Compatibility mappings by kind that keep the look; <super>, <sub>, <circle>, <fraction>, <font>, ... do not.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>")
#: <compat> mappings that are not the same look although they share the tag.
NOT_SAME = ((0x2024, 0x2026), (0x2033, 0x2057), (0x2100, 0x2121), (0x222C, 0x2230), (0x2474, 0x24B5), (0x2A0C, 0x2A76), (0x3200, 0x33FF), (0x1F100, 0x1F1FF), (0xA8, 0xB8), (0x2D8, 0x2DD), (0x37A, 0x385), (0x1FBD, 0x1FFE), (0x2017, 0x2017), (0x203C, 0x203C), (0x203E, 0x203E), (0x2047, 0x2049))
TOP = 0x110000
HANGUL_S, HANGUL_L, HANGUL_V, HANGUL_T = 0xAC00, 0x1100, 0x1161, 0x11A7


def _in(cp: int, ranges: tuple) -> bool:
    return any(a <= cp <= b for a, b in ranges)


@cache
def tables() -> dict[str, np.ndarray]:
    """Built once per Python worker from the Unicode database: replacement, combining class and composition tables."""
    alike = {ord(a): b for a, b in (x.split("=") for x in LOOKALIKES.split())}
    memo: dict[int, str] = {}

    def full(cp: int) -> str:
        if cp in memo:
            return memo[cp]
        memo[cp] = chr(cp)
        if _in(cp, IGNORABLE):
            out = ""
        elif cp in alike:
            out = alike[cp]
        elif cp != 0x20 and unicodedata.category(chr(cp)) == "Zs":
            out = " "
        else:
            kind, parts = "", unicodedata.decomposition(chr(cp)).split()
            if parts and parts[0][0] == "<":
                kind, parts = parts[0], parts[1:]
            skip = kind and (kind not in SAME_LOOK or (_in(cp, NOT_SAME) and kind == "<compat>"))
            out = chr(cp) if not parts or skip else "".join(full(int(p, 16)) for p in parts)
        if cp == 0xB5:
            out = "μ"
        memo[cp] = out
        return out

    size = np.ones(TOP, np.int8)
    first = np.arange(TOP, dtype=np.uint32)
    start = np.zeros(TOP, np.int32)
    ccc = np.zeros(TOP, np.uint8)
    pool: list[int] = []
    pairs: dict[tuple[int, int], int] = {}
    for cp in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x1FC00), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE1000)):
        c = chr(cp)
        ccc[cp] = unicodedata.combining(c)
        new = full(cp)
        if new != c:
            size[cp] = len(new)
            first[cp] = ord(new[0]) if new else 0
            start[cp] = len(pool)
            pool.extend(map(ord, new))
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", c) == c:
            pairs[int(parts[0], 16), int(parts[1], 16)] = cp
    key = [a << 21 | b for a, b in pairs]
    val = list(pairs.values())
    for lv in range(19 * 21):
        s = HANGUL_S + lv * 28
        key.append((HANGUL_L + lv // 21) << 21 | (HANGUL_V + lv % 21))
        val.append(s)
        key.extend(s << 21 | (HANGUL_T + t) for t in range(1, 28))
        val.extend(s + t for t in range(1, 28))
    k, v = np.array(key, np.int64), np.array(val, np.uint32)
    o = np.argsort(k)
    second = np.zeros(TOP, bool)
    second[(k & 0x1FFFFF)] = True
    return {"size": size, "first": first, "start": start, "pool": np.array(pool, np.uint32), "ccc": ccc, "key": k[o], "val": v[o], "second": second}


def canonical_codepoints(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = tables()
    # gather and expand
    n = t["size"][cp]
    changed = (n != 1).any()
    if changed:
        end = np.cumsum(n, dtype=np.int64)
        out = np.repeat(t["first"][cp], n)
        multi = np.flatnonzero(n > 1)
        if len(multi):
            m = n[multi].astype(np.int64)
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            out[np.repeat(end[multi] - m, m) + step] = t["pool"][np.repeat(t["start"][cp[multi]].astype(np.int64), m) + step]
        off = np.concatenate([[0], end])[off]
    else:
        out = t["first"][cp]
    # order and compose marks
    mark = t["second"][out] | (t["ccc"][out] > 0)
    if mark.any():
        own = owners(off)
        ccc = t["ccc"][out]
        inner = np.zeros(len(out), bool)
        inner[1:] = (ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (own[1:] == own[:-1])
        if inner.any():  # canonical order: sort every run of marks by class, stable
            run = np.cumsum((ccc == 0) | np.concatenate([[True], own[1:] != own[:-1]]))
            out = out[np.lexsort((np.arange(len(out)), ccc, run))]
            ccc = t["ccc"][out]
        alive = np.ones(len(out), bool)
        at = np.arange(len(out))
        base = np.maximum.accumulate(np.where(ccc == 0, at, 0))
        pos = np.flatnonzero(mark)
        todo = pos[pos > 0]
        # a jamo is a starter itself: its base is what stands before it
        before = np.where(ccc[todo] == 0, base[todo - 1], base[todo])
        tail = (out[todo] > HANGUL_T) & (out[todo] < HANGUL_T + 28)  # may follow a syllable composed in the first round
        level = np.where(ccc[todo] == 0, 1 + tail, todo - before)
        last = np.zeros(len(out), np.uint8)  # class of the last mark left uncomposed on a base
        head = at.copy()
        for r in range(1, int(level.max()) + 1 if len(level) else 0):
            i = todo[level == r]
            b = head[before[level == r]]
            joins = np.where(ccc[i] == 0, (i - 1 == b) | ~alive[i - 1], last[b] < ccc[i])  # a starter must touch, a mark must not be blocked
            ok = (own[i] == own[b]) & (i != b) & joins
            k = out[b].astype(np.int64) << 21 | out[i]
            j = np.minimum(np.searchsorted(t["key"], k), len(t["key"]) - 1)
            ok &= t["key"][j] == k
            out[b[ok]] = t["val"][j[ok]]
            alive[i[ok]] = False
            head[i[ok]] = b[ok]
            left = ~ok & (ccc[i] > 0)
            last[b[left]] = ccc[i[left]]
        if not alive.all():
            off = np.concatenate([[0], np.cumsum(alive)])[off]
            out = out[alive]
    return out, off


def canonical_array(arr: pa.Array) -> pa.Array:
    """Canonical form of an Arrow string array; nulls stay null, empty text stays empty."""
    cp, off = codepoints(arr)
    if not len(cp):
        return arr
    new, noff = canonical_codepoints(cp, off)
    return to_strings(new, noff, np.asarray(arr.is_valid()) if arr.null_count else None)


def canonical_text(df: DataFrame, column: str, out: str = "canonical", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) and ``out``, the one form of ``column``. Narrow: no shuffle.

    Null stays null and empty stays empty; repeated rows are treated each for itself. An ``out`` that clashes with
    a kept column is an error.
    """
    names = df.columns if keep is None else keep
    if out in names:
        raise ValueError(f"{out!r} is already a column")
    src = df.select(*names, F.col(column).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = canonical_array(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], c.cast(pa.string())], names=[*names, out])

    return src.mapInArrow(run, T.StructType([*(df.schema[n] for n in names), T.StructField(out, T.StringType())]))


def same_look_pairs(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(``id_col``_a, ``id_col``_b), a < b: rows whose ``column`` looks alike but is stored differently.

    Every canonical form is a class, every stored form in it a member. Classes with one member end in a map-side
    combined aggregate; only members of the others are joined, form by form (few) and then form to rows, so that
    the work follows the result's size and a form that holds a third of all rows is never paired with itself.
    Null and empty texts give no pairs; a repeated id counts once.
    """
    rows = canonical_text(df.filter(F.length(column) > 0).select(F.col(id_col).alias("id"), F.col(column).alias("t")), "t", "c")
    rows = materialise(rows.select("id", F.xxhash64("c").alias("c1"), F.xxhash64("c", F.lit(1)).alias("c2"), F.xxhash64("t").alias("t1"), F.xxhash64("t", F.lit(1)).alias("t2")))
    several = rows.groupBy("c1", "c2").agg(F.min(F.struct("t1", "t2")).alias("lo"), F.max(F.struct("t1", "t2")).alias("hi")).filter("lo != hi").select("c1", "c2")
    member = materialise(rows.join(several, ["c1", "c2"], "left_semi").distinct())
    form = member.select("c1", "c2", "t1", "t2").distinct()
    other = form.select("c1", "c2", F.col("t1").alias("u1"), F.col("t2").alias("u2"))
    pair = form.join(other, ["c1", "c2"]).filter("t1 < u1 OR (t1 = u1 AND t2 < u2)")
    a = member.select("c1", "c2", "t1", "t2", F.col("id").alias("a"))
    b = member.select("c1", "c2", F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("id").alias("b"))
    both = pair.join(a, ["c1", "c2", "t1", "t2"]).join(b, ["c1", "c2", "u1", "u2"]).filter("a != b")
    return both.select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b")).distinct()


def same_look_classes(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(``id_col``, class_id, n_rows, n_forms): every row whose ``column`` looks like a differently stored one, by class.

    ``class_id`` is the smallest id of the class, ``n_rows`` its rows and ``n_forms`` its stored forms. A row a member,
    where same_look_pairs has a row a pair, so a class that holds a third of all rows grows in proportion. Null and empty
    texts belong to no class; a repeated id counts once a stored form.
    """
    rows = canonical_text(df.filter(F.length(column) > 0).select(F.col(id_col).alias("id"), F.col(column).alias("t")), "t", "c")
    rows = materialise(rows.select("id", F.xxhash64("c").alias("c1"), F.xxhash64("c", F.lit(1)).alias("c2"), F.xxhash64("t").alias("t1"), F.xxhash64("t", F.lit(1)).alias("t2")).distinct())
    form = rows.groupBy("c1", "c2", "t1", "t2").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    kind = form.groupBy("c1", "c2").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_rows"), F.count("*").alias("n_forms")).filter("n_forms > 1")
    return rows.join(kind, ["c1", "c2"]).select(F.col("id").alias(id_col), "class_id", "n_rows", "n_forms").distinct()
