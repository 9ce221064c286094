"""Several values packed in one field -> one value per row, position kept.

Works on whole Arrow batches: the list column's child strings are one flat
code-point array; quote parity, bracket depth, delimiter and label masks are
computed over it at once, cut positions become child offsets, and the pieces are
flattened with their parent's ordinal. There is no Python loop over rows.

How an element is cut (first rule that gives two or more non-empty pieces):

* *labels*: the element starts with an option label (``A.`` ``A．`` ``A、`` ``A)``
  ``A:`` ``(A)`` ``（A）``, A to H); it is cut before every later label of the same style
  that continues the alphabet, up to Z, and follows white space or a delimiter, whatever
  mixture of delimiters stands between. So is an element that starts with ``a`` or ``1``
  in such a style (numbers: not with a colon, nor before a digit) if the next label follows.
* *quotes*: values in ``"``, ``'`` or ``“ ”``; delimiters inside quotes never
  cut; ``[...]`` around quoted values (a JSON list) is peeled off.
* *strong delimiters*: ``||``, tab, line end, ``#``, ``‖``, ``｜``, ``¦``, ``|``, runs of two or more
  blanks or an ideographic space.
* *weak delimiters*, which also occur inside a single value (``；`` ``;`` ``、``
  `` / `` ``，`` ``,``): only if they give at least ``weak_min`` pieces, or if a
  quoted value touches the delimiter.

Bars of an absolute value (``|x|``), delimiters in round brackets and decimal
points never cut. If several delimiters qualify, the one with most pieces wins,
ties by the order above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.arrowtext import codepoints, owners, to_strings


def _o(s: str) -> np.ndarray:
    return np.array([ord(c) for c in s], np.uint32)


SPACE = _o(" \t\n\r　    ​﻿")
DELIM = _o(";；|‖｜¦/,，、#\t\n\r")
LABEL_END = _o(".．、)）:：")
OPEN, CLOSE = _o("(（"), _o(")）")
STRONG = ("||", "\t", "\n", "#", "‖", "｜", "¦", "|", "  ")
WEAK = ("；", ";", "、", " / ", "，", ",")
TRIM = np.concatenate([SPACE, _o(";；|‖｜¦/,，、#")])


class _Flat:
    """Flat text of one batch of elements with the row geometry that the masks need."""

    def __init__(self, cp: np.ndarray, off: np.ndarray):
        self.cp, self.off, self.n = cp, off, len(off) - 1
        self.own = owners(off)
        self.at = np.arange(len(cp))
        self.space = np.isin(cp, SPACE)
        size = len(cp)
        # nearest non-blank neighbour to the left and right, within the element (-1: none)
        bar = cp == ord("|")
        # |x| : bar, one letter, bar, followed by a blank or a comparison
        one, two, three = self.next(1), self.next(2), self.next(3)
        word = ((one >= ord("a")) & (one <= ord("z"))) | ((one >= ord("A")) & (one <= ord("Z")))
        start = bar & word & (two == ord("|")) & np.isin(three, _o(" <>=≤≥+-"))
        self.absolute = start.copy()
        self.absolute[2:] |= start[:-2]
        solid = np.where(~self.space, self.at, -1)
        left = np.concatenate([[-1], np.maximum.accumulate(solid)[:-1]]) if size else solid
        self.left = np.where(left >= off[self.own], left, -1) if size else left
        solid = np.where(~self.space, self.at, size)
        right = np.concatenate([np.minimum.accumulate(solid[::-1])[::-1][1:], [size]]) if size else solid
        self.right = np.where(right < off[self.own + 1], right, -1) if size else right

    def prev(self, k: int = 1) -> np.ndarray:
        """Code point k to the left inside the element, else 0."""
        out = np.zeros_like(self.cp)
        if len(out) > k:
            out[k:] = np.where(self.own[k:] == self.own[:-k], self.cp[:-k], 0)
        return out

    def next(self, k: int = 1) -> np.ndarray:
        out = np.zeros_like(self.cp)
        if len(out) > k:
            out[:-k] = np.where(self.own[k:] == self.own[:-k], self.cp[k:], 0)
        return out

    def running(self, flag: np.ndarray) -> np.ndarray:
        """Inclusive running sum within the element."""
        total = np.cumsum(flag.astype(np.int64))
        base = np.concatenate([[0], total])[self.off[:-1]]
        return total - base[self.own]

    def totals(self, flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag.astype(np.int64))])
        return c[self.off[1:]] - c[self.off[:-1]]


def _quotes(f: _Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inside quotes, opening quote, closing quote); a family that doesn't close in an element is ignored there."""
    inside = np.zeros(len(f.cp), bool)
    opening = np.zeros(len(f.cp), bool)
    closing = np.zeros(len(f.cp), bool)
    # what stands next to a quote that delimits a value
    lead = np.where(f.left >= 0, f.cp[f.left], 0)
    tail = np.where(f.right >= 0, f.cp[f.right], 0)
    edge = np.concatenate([DELIM, _o("[]\"'“”"), np.zeros(1, np.uint32)])
    starts, ends = np.isin(lead, edge), np.isin(tail, edge)
    slash = f.prev() == ord("\\")
    for q in "\"'":
        mark = (f.cp == ord(q)) & ~slash
        if q == "'":
            mark &= starts | ends
        count = f.running(mark)
        good = (f.totals(mark) % 2 == 0)[f.own]
        odd = (count % 2 == 1) & good
        op = mark & odd & starts
        # a pair that does not begin at a value's edge is part of the value and hides nothing
        pair = (count + 1) // 2
        key = f.own.astype(np.int64) << 20 | np.minimum(pair, (1 << 20) - 1)
        real = np.isin(key, key[op])
        inside |= odd & real
        opening |= op
        closing |= mark & ~odd & good & real
    up, down = f.cp == ord("“"), f.cp == ord("”")
    good = (f.totals(up) == f.totals(down))[f.own]
    inside |= ((f.running(up) - f.running(down)) > 0) & good
    return inside, opening | (up & good), closing | (down & good)


def _brackets(f: _Flat) -> np.ndarray:
    up, down = np.isin(f.cp, OPEN), np.isin(f.cp, CLOSE)
    depth = f.running(up) - f.running(down)
    good = (f.totals(up) == f.totals(down))[f.own]
    return (depth > 0) & good


def _labels(f: _Flat) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions before labels, and per element whether it starts with a label."""
    none = np.zeros(0, np.int64), np.zeros(f.n, bool)
    if not len(f.cp):
        return none
    upper, lower = (f.cp >= ord("A")) & (f.cp <= ord("Z")), (f.cp >= ord("a")) & (f.cp <= ord("z"))
    digit = (f.cp >= ord("0")) & (f.cp <= ord("9"))
    after = f.next()
    # a number is told by its last digit; its value and first place come from the run of digits
    run = digit & ~((f.prev() >= ord("0")) & (f.prev() <= ord("9")))
    start = np.maximum.accumulate(np.where(run | ~digit, f.at, 0))
    near = f.at - start
    value = np.where(near == 0, 0, np.where(near == 1, f.prev().astype(np.int64) - 48, f.prev(2).astype(np.int64) * 10 + f.prev() - 528)) * 10 + f.cp.astype(np.int64) - 48
    after2 = f.next(2)
    number = digit & (near <= 2) & (after != ord(":")) & (after != ord("：")) & ~((after2 >= ord("0")) & (after2 <= ord("9")))
    first_at = np.where(digit, start, f.at)
    lead = np.where(first_at > f.off[f.own], f.cp[np.maximum(first_at - 1, 0)], 0)
    end = (upper | lower | number) & np.isin(after, LABEL_END)
    wrapped = end & np.isin(lead, OPEN) & np.isin(after, CLOSE)
    style = np.where(wrapped, 1, np.where(after == ord("．"), ord("."), np.where(after == ord("）"), ord(")"), np.where(after == ord("："), ord(":"), after)))).astype(np.int64)
    style = style * 3 + np.where(lower, 1, np.where(digit, 2, 0))
    begin = first_at - wrapped
    before = np.where(begin > f.off[f.own], f.cp[np.maximum(begin - 1, 0)], 0)
    free = (before == 0) | np.isin(before, SPACE) | np.isin(before, DELIM) | np.isin(before, _o("。.") )
    cand = np.flatnonzero(end & free & (wrapped | ~np.isin(lead, OPEN)))
    if not len(cand):
        return none
    let = np.where(digit, value, np.where(lower, f.cp.astype(np.int64) - ord("a"), f.cp.astype(np.int64) - ord("A")))[cand]
    own, pos, sty = f.own[cand], begin[cand], style[cand]
    kind = sty % 3
    first = (f.left[pos] < 0) & np.where(kind == 0, let <= 7, np.where(kind == 1, let == 0, let == 1))
    # two labels can't both be first; keep the first one of an element
    head = np.full(f.n, -1)
    head[own[first][::-1]] = np.flatnonzero(first)[::-1]
    has = head >= 0
    # element, style and letter in one word, so that labels of other styles are never looked at
    chain = lambda e, s, v: (e.astype(np.int64) * 3 * (1 << 21) + s) * 1024 + v
    known, place = np.unique(chain(own, sty, let), return_inverse=True)
    big = np.int64(len(f.cp) + 1)
    spots = np.sort(place * big + pos)
    cuts = []
    el = np.flatnonzero(has)
    cur, let0, sty0 = pos[head[el]], let[head[el]], sty[head[el]]
    tried = 0
    while len(el):
        tried += 1
        want = chain(el, sty0, let0 + 1)
        rank = np.searchsorted(known, want)
        there = rank < len(known)
        there[there] = known[rank[there]] == want[there]
        at = np.searchsorted(spots, rank * big + cur, "right")  # the first one beyond the current label
        ok = there & (at < len(spots))
        ok[ok] = spots[at[ok]] // big == rank[ok]
        if tried == 1:  # lower case and numbers only count if the next one follows
            has[el[~ok & (sty0 % 3 > 0)]] = False
        nxt = spots[at[ok]] % big
        cuts.append(nxt)
        el, cur, let0, sty0 = el[ok], nxt, let0[ok] + 1, sty0[ok]
    return (np.concatenate(cuts) if cuts else np.zeros(0, np.int64)), has


def _delims(f: _Flat, hidden: np.ndarray, opening: np.ndarray, closing: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each delimiter: (start, end) of its occurrences that may cut."""
    free = ~hidden & ~opening & ~closing
    nxt = f.next(1)
    bar = (f.cp == ord("|")) & ~f.absolute & free
    double = np.zeros(len(bar), bool)
    if len(bar) > 1:
        run = f.own[:-1] == f.own[1:]
        double[:-1] = bar[:-1] & bar[1:] & run
        prevd = np.zeros(len(bar), bool)
        for _ in range(2):  # leftmost, not overlapping
            prevd[1:] = double[:-1]
            double &= ~prevd
    blank = (f.space & (f.cp != ord("\t")) & (f.cp != ord("\n")) & (f.cp != ord("\r"))) & free
    prevblank = np.zeros(len(blank), bool)
    prevblank[1:] = blank[:-1] & (f.own[1:] == f.own[:-1])
    wide = blank & (prevblank | (f.cp == 0x3000)) & (f.left >= 0) & (f.right >= 0)
    bare = f.prev()
    out = {}
    at = f.at
    out["||"] = (at[double], at[double] + 2)
    for d in ("\t", "\n", "#", "‖", "｜", "¦", "；", ";", "、", "，"):
        m = (f.cp == ord(d)) & free
        out[d] = (at[m], at[m] + 1)
    out["|"] = (at[bar], at[bar] + 1)
    out["  "] = (at[wide], at[wide] + 1)
    comma = (f.cp == ord(",")) & free
    digits = (bare >= 48) & (bare <= 57) & (nxt >= 48) & (nxt <= 57)
    comma &= ~digits
    out[","] = (at[comma], at[comma] + 1)
    m = (f.cp == ord("/")) & free & np.isin(bare, SPACE) & np.isin(nxt, SPACE)
    out[" / "] = (at[m], at[m] + 1)
    return out


def _pieces(f: _Flat, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty trimmed pieces (element, from, to) between cuts [start, end)."""
    if not len(f.cp):
        none = np.zeros(0, np.int64)
        return none, none, none
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    own = f.own[start] if len(start) else np.zeros(0, np.int64)
    el = np.concatenate([np.arange(f.n), own])
    lo = np.concatenate([f.off[:-1], end])
    o = np.lexsort((lo, el))
    el, lo = el[o], lo[o]
    hi = np.concatenate([f.off[:-1][1:] if f.n else [], f.off[-1:]])
    stop = np.concatenate([start, hi[: f.n]])
    o2 = np.lexsort((stop, np.concatenate([own, np.arange(f.n)])))
    stop = stop[o2]
    trim = np.isin(f.cp, TRIM) & ~f.absolute
    solid = np.concatenate([[0], np.cumsum(~trim)])
    keep = solid[np.maximum(stop, lo)] > solid[lo]
    el, lo, stop = el[keep], lo[keep], stop[keep]
    # trim by the position of the first and last solid character
    idx = np.flatnonzero(~trim)
    return el, idx[solid[lo]], idx[solid[stop] - 1] + 1


def cut_elements(child: pa.Array, alone: np.ndarray, weak_min: int = 3) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Pieces of every string: (element of each piece, piece, pieces per element); null and blank elements have none.

    ``alone``: whether the element is the only non-blank one of its list; weak delimiters cut only then.
    """
    cp, off = codepoints(child)
    f = _Flat(cp, off)
    inside, opening, closing = _quotes(f)
    # a JSON list: brackets at both ends and a quote next to them
    head = np.full(f.n, -1)
    tail = np.full(f.n, -1)
    solid = np.flatnonzero(~f.space)
    if len(solid):
        head[f.own[solid][::-1]] = solid[::-1]
        tail[f.own[solid]] = solid
    json = np.zeros(f.n, bool)
    ok = head >= 0
    if ok.any():
        h, t = head[ok], tail[ok]
        inner = np.where(f.right[h] >= 0, f.right[h], h)
        json[ok] = (cp[h] == ord("[")) & (cp[t] == ord("]")) & opening[inner]
    hidden = inside | (_brackets(f) if len(cp) else inside)
    cut_l, labelled = _labels(f)
    delims = _delims(f, hidden, opening, closing)
    # blanks between a closing and an opening quote
    gap = f.space & (f.left >= 0) & (f.right >= 0)
    gap[gap] &= closing[f.left[gap]] & opening[f.right[gap]]
    best = np.zeros(f.n, np.int64)
    which = np.full(f.n, -1)
    names = [*STRONG, *WEAK, "gap"]
    delims["gap"] = (f.at[gap], f.at[gap] + 1)
    for k, d in enumerate(names):
        s, e = delims[d]
        el, _, _ = _pieces(f, s, e)
        n = np.bincount(el, minlength=f.n)
        if d in WEAK:
            near = np.zeros(f.n, bool)
            if len(s):
                l, r = f.left[s], f.right[s]
                q = ((l >= 0) & closing[np.maximum(l, 0)]) | ((r >= 0) & opening[np.maximum(r, 0)])
                near[f.own[s[q]]] = True
            n = np.where(near | (alone & (n >= weak_min)), n, 0)
        better = (n > best) & (n >= 2) & ~labelled
        best[better], which[better] = n[better], k
    start, end = [cut_l], [cut_l]
    for k, d in enumerate(names):
        s, e = delims[d]
        mine = which[f.own[s]] == k if len(s) else np.zeros(0, bool)
        start.append(s[mine])
        end.append(e[mine])
    s, e = np.concatenate(start).astype(np.int64), np.concatenate(end).astype(np.int64)
    # peel the brackets of JSON lists
    j = np.flatnonzero(json & (which >= 0))
    s, e = np.concatenate([s, head[j], tail[j]]), np.concatenate([e, head[j] + 1, tail[j] + 1])
    el, lo, hi = _pieces(f, s, e)
    # quotes around a whole piece go; doubled and escaped quotes inside become single
    if len(lo):
        wrapped = opening[lo] & closing[hi - 1] & (hi - lo > 1) & (which[el] >= 0)
        lo, hi = lo + wrapped, hi - wrapped
    else:
        wrapped = np.zeros(0, bool)
    keep = hi > lo
    el, lo, hi, wrapped = el[keep], lo[keep], hi[keep], wrapped[keep]
    length = hi - lo
    src = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]) if len(lo) else lo, length) + np.arange(length.sum())
    drop = np.zeros(len(cp), bool)
    if len(cp):
        q = f.cp == ord('"')
        begin = np.maximum.accumulate(np.where(q & ~np.concatenate([[False], q[:-1]]), f.at, -1))
        inner = np.zeros(len(cp) + 1, np.int64)  # within a value that was wrapped in quotes
        np.add.at(inner, lo[wrapped], 1)
        np.add.at(inner, hi[wrapped], -1)
        inner = np.cumsum(inner)
        begin = np.maximum(begin, np.repeat(lo, length)[np.searchsorted(src, f.at).clip(0, max(len(src) - 1, 0))] if len(src) else begin)
        doubled = q & (f.next() == ord('"')) & ((f.at - begin) % 2 == 0) & (inner[:-1] > 0) & (inner[1:] > 0)
        drop = doubled | ((f.cp == ord("\\")) & (f.next() == ord('"')) & (inner[:-1] > 0))
    kept = ~drop[src]
    out_off = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(length)])]
    return el, to_strings(cp[src][kept], out_off), np.bincount(el, minlength=f.n)


def split_batch(batch: pa.RecordBatch, keys: list[str], column: str, only_packed: bool, weak_min: int) -> pa.RecordBatch:
    lists = batch.column(batch.schema.get_field_index(column))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
    child = lists.flatten()
    row = np.repeat(np.arange(len(lists)), size)
    solid = np.asarray(pa.compute.fill_null(pa.compute.greater(pa.compute.utf8_length(pa.compute.utf8_trim_whitespace(child)), 0), False)) if len(child) else np.zeros(0, bool)
    per_row = np.bincount(row[solid], minlength=len(lists)) if len(child) else np.zeros(len(lists), np.int64)
    el, value, n = cut_elements(child, (per_row == 1)[row], weak_min)
    parent = row[el]
    packed = np.zeros(len(lists), bool)
    packed[row[n >= 2]] = True
    starts = np.searchsorted(parent, parent, "left") if len(parent) else parent
    pos = np.arange(len(parent)) - starts + 1
    first_el = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
    elem = el - first_el[parent] + 1 if len(el) else el
    keep = packed[parent] if only_packed else np.ones(len(parent), bool)
    take = pa.array(parent[keep])
    cols = [batch.column(batch.schema.get_field_index(k)).take(take) for k in keys]
    cols += [pa.array(pos[keep].astype(np.int32)), pa.array(elem[keep].astype(np.int32)), value.filter(pa.array(keep)), pa.array(packed[parent[keep]])]
    return pa.RecordBatch.from_arrays(cols, names=[*keys, "val_pos", "elem_pos", "value", "is_packed"])


def split_packed(df: DataFrame, keys: list[str], column: str, only_packed: bool = False, weak_min: int = 3) -> DataFrame:
    """One row per value packed in ``column`` (array of strings): ``keys``, val_pos, elem_pos, value, is_packed.

    ``val_pos`` counts the values of a row over the whole array from 1; ``elem_pos`` is the element a value came
    from. Null and empty arrays, null and blank elements and empty pieces give no rows. Repeated input rows are
    split each for itself. ``only_packed`` keeps rows in which at least one element held several values. Columns
    other than ``keys`` are not carried, so that clashing names do no harm. Narrow: no shuffle.
    """
    own = {"val_pos", "elem_pos", "value", "is_packed"} & set(keys)
    if own:
        raise ValueError(f"key columns {sorted(own)} clash with result columns")
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("val_pos", T.IntegerType()), T.StructField("elem_pos", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("is_packed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield split_batch(b, keys, column, only_packed, weak_min)

    return df.select(*keys, column).mapInArrow(run, schema)
