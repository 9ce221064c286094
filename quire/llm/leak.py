"""Evaluation passages inside a training corpus, by greedy string tiling.

Texts are decoded, lower-cased and reduced to letters, digits and ideographs, so that layout, quoting, mark-up,
punctuation and line breaks vanish. Seeds are windows of ``SEED`` characters hashed Karp-Rabin fashion (by doubling, for
all positions of a batch at once). Document and item are joined on seeds; runs of seeds on a diagonal are the maximal
common passages. Greedy tiling marks the longest of them, trims the others to what is still unmarked on both sides, and
so on, until none of at least a seed is left; the tiles' share of the item is its coverage.

A pair counts if one passage holds enough consecutive words (or characters, for items without spaces), or, where
``min_coverage`` is given, if the tiles cover that share of the item: that finds passages whose parts were reordered.

A seed-hit needs the items' seeds on every worker. They are sent there only while the items' text is under
``max_broadcast_chars``; beyond it both sides are joined on seeds by shuffle: on winnowed ones whose windows are as wide
as the shortest passage that counts, so that every such passage shares one (with ``min_coverage`` on all seeds). Both
ways give the same rows.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.arrowtext import codepoints, owners
from quire.llm.mail import all_text
from quire.session import materialise

SEED = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"[^\W_]+")
HAN = re.compile("[㐀-鿿豈-﫿]")
MIN_WORDS, MIN_CHARS = 15, 30


def plain(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


@cache
def _alnum() -> np.ndarray:
    keep = np.zeros(0x110000, bool)
    keep[: 0x32000] = [chr(c).isalnum() for c in range(0x32000)]
    return keep


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of the texts' letters and digits."""
    cp, off = codepoints(pa.array(texts, pa.string()))
    keep = _alnum()[cp]
    return cp[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def seed_hashes(cp: np.ndarray, off: np.ndarray, size: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the window of ``size`` characters that starts at each position; row -1 where it would leave the text."""
    n = len(cp) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        # windows of 1, 2, 4 ... characters; those that make up ``size`` are chained
        part, width, power = cp.astype(np.uint64) + np.uint64(1), 1, BASE
        h, done = np.zeros(len(cp), np.uint64), 0
        while True:
            if size & width:
                full = len(cp) - done - width + 1
                h = h[:full] * power + part[done : done + full]
                done += width
            if 2 * width > size:
                break
            part = part[: len(part) - width] * power + part[width:]
            power, width = power * power, 2 * width
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    own = owners(off)
    return h, np.where(own[:n] == own[size - 1 :], own[:n], -1)


def tile(runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: tiles (length, place in the item, place in the text) out of maximal matches of that form.

    The longest match is marked (of equal ones the first in the item, then in the text); whatever of another match is
    already marked on either side is cut off it, and its free parts of at least ``least`` characters wait their turn.
    """
    heap = [(-n, p, d) for n, p, d in runs if n >= least]
    heapq.heapify(heap)
    taken: tuple[list, list] = ([], [])
    out = []
    while heap:
        n, p, d = heapq.heappop(heap)
        n = -n
        # free parts as offsets within the match: what no tile covers in the item nor in the text
        free = [(0, n)]
        for at, marked in zip((p, d), taken):
            for a, b in marked:
                lo, hi = a - at, b - at
                if lo < n and hi > 0:
                    free = [y for x in free for y in ((x[0], min(x[1], lo)), (max(x[0], hi), x[1])) if y[1] > y[0]]
        if free == [(0, n)]:
            out.append((n, p, d))
            taken[0].append((p, p + n))
            taken[1].append((d, d + n))
        else:
            for lo, hi in free:
                if hi - lo >= least:
                    heapq.heappush(heap, (lo - hi, p + lo, d + lo))
    return out


class Items:
    """The items' seeds, sorted, with the geometry needed for tiles."""

    def __init__(self, rows: list[tuple[int, str]], size: int = SEED):
        text = [plain(t) for _, t in rows]
        self.ids, self.seed = [i for i, _ in rows], size
        self.cp, self.off = letters(text)
        h, own = seed_hashes(self.cp, self.off, size)
        pos = np.flatnonzero(own >= 0)
        order = np.argsort(h[pos], kind="stable")
        self.hash, self.pos, self.own = h[pos][order], pos[order], own[pos][order]
        # a bit table of about 16 places a seed, at most 2^20
        self.shift = np.uint64(64 - min(20, max(6, 4 + len(pos).bit_length())))
        self.filter = np.zeros(1 << (64 - int(self.shift)), bool)
        self.filter[(self.hash >> self.shift).astype(np.int64)] = True
        self.ends, self.starts, self.spaced = [], [], []
        for t in text:
            w = np.cumsum([0, *(len(x) for x in WORD.findall(t))])
            self.starts.append(w[:-1])
            self.ends.append(w[1:])
            self.spaced.append(len(HAN.findall(t)) * 4 < len(t))
        self.size = np.diff(self.off)

    def least_passage(self, min_words: int, min_chars: int) -> int:
        """Characters of the shortest passage that counts."""
        least = min_chars
        for ends, starts, spaced in zip(self.ends, self.starts, self.spaced):
            if spaced and len(ends) >= min_words:
                least = min(least, int((ends[min_words - 1 :] - starts[: len(ends) - min_words + 1]).min()))
        return max(1, least)

    def hits(self, cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position in the batch, index into the sorted seeds), one per equal seed."""
        h, own = seed_hashes(cp, off, self.seed)
        at = np.flatnonzero((own >= 0) & self.filter[(h >> self.shift).astype(np.int64)]) if len(h) else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        n = hi - lo
        seed = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(n.sum())
        return np.repeat(own[at], n), np.repeat(at, n), seed

    def tiles(self, cp: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(row, item index, most consecutive words in one passage, most characters, share of the item that tiles cover)."""
        row, at, seed = self.hits(cp, off)
        if not len(row):
            return []
        item, j = self.own[seed], self.pos[seed]
        o = np.lexsort((at, at - j, item, row))
        row, item, at, j = row[o], item[o], at[o], j[o]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] - j[1:] != at[:-1] - j[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        length = np.diff(np.concatenate([first, [len(row)]])) + self.seed - 1
        out = []
        pair = row[first].astype(np.int64) * len(self.ids) + item[first]
        cuts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        for a, b in zip(cuts, np.concatenate([cuts[1:], [len(pair)]])):
            it = int(item[first[a]])
            base = self.off[it]
            runs = [(int(length[x]), int(j[first[x]] - base), int(at[first[x]])) for x in range(a, b)]
            words = max(int(np.searchsorted(self.ends[it], p + n, "right") - np.searchsorted(self.starts[it], p)) for n, p, _ in runs)
            covered = sum(n for n, _, _ in tile(runs, self.seed))
            out.append((int(row[first[a]]), it, max(words, 0), max(n for n, _, _ in runs), covered / int(self.size[it])))
        return out

    def leaked(self, item: int, words: int, chars: int, min_words: int, min_chars: int) -> bool:
        return words >= min_words if self.spaced[item] else chars >= min_chars


def winnow(cp: np.ndarray, off: np.ndarray, span: int, size: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), distinct: the least seed of every ``span`` neighbouring ones; of all where a text has fewer. Linear in the text."""
    h, own = seed_hashes(cp, off, size)
    ok = own >= 0
    h, own = h[ok], own[ok]
    if not len(h):
        return own, h.view(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    count = np.diff(np.concatenate([begin, [len(own)]]))
    short = count < span
    rows, hashes = [own[begin][short]], [np.minimum.reduceat(h, begin)[short]]
    if len(h) >= span:
        least, width = h, 1
        while 2 * width <= span:
            least, width = np.minimum(least[: len(least) - width], least[width:]), 2 * width
        if width < span:
            least = np.minimum(least[: len(h) - span + 1], least[span - width :])
        inside = own[: len(least)] == own[span - 1 :]
        rows.append(own[: len(least)][inside])
        hashes.append(least[inside])
    r, x = np.concatenate(rows), np.concatenate(hashes)
    o = np.lexsort((x, r))
    r, x = r[o], x[o]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])])
    return r[new], x[new].view(np.int64)


def eval_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", decode: bool = True, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, min_coverage: float | None = None, max_broadcast_chars: int = 8_000_000
) -> DataFrame:
    """(doc_id, item_id, words, chars, coverage): documents with a passage of an item.

    An item with spaces leaks if at least ``min_words`` consecutive words of it stand in the document, one of
    ideographs if ``min_chars`` consecutive characters do. With ``min_coverage`` an item leaks as well if tiles of at
    least a seed (16 characters) cover that share of it, in whatever order they stand. ``items`` has item_id and text.
    Null and empty texts give nothing; a repeated document gives its rows again, a repeated item_id counts once per
    text. With ``decode`` the text is a raw mail message. Narrow (no shuffle) while the items are small.
    """
    its = items.select("item_id", "text").filter(F.length("text") > 0).distinct()
    total = its.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    read = all_text if decode else (lambda t: t or "")
    out = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("item_id", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("chars", T.IntegerType()), T.StructField("coverage", T.DoubleType())])
    src = docs.select(doc_id, text).filter(F.length(text) > 0)

    def counts(known: Items, got: list[tuple]) -> list[tuple]:
        return [g for g in got if known.leaked(g[1], g[2], g[3], min_words, min_chars) or (min_coverage is not None and g[4] >= min_coverage)]

    if total <= max_broadcast_chars:
        rows = [(r.item_id, r.text) for r in its.collect()]
        known = Items(rows)
        least = known.least_passage(min_words, min_chars)
        if least < SEED:  # fifteen very short words
            known = Items(rows, least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = counts(known, known.tiles(*letters([plain(read(t)) for t in b.column(1).to_pylist()])))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([g[0] for g in got], pa.int64())), pa.array([known.ids[g[1]] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.int32()), pa.array([g[4] for g in got], pa.float64())], names=out.names)

        return src.mapInArrow(run, out)

    def shortest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([Items([(0, t)]).least_passage(min_words, min_chars) for t in b.column(0).to_pylist()], pa.int64())], names=["n"])

    least = its.select("text").mapInArrow(shortest, "n long").agg(F.min("n")).first()[0]
    size = min(SEED, least)
    span = 1 if min_coverage is not None else least - size + 1

    def seeds(decoding):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, h = winnow(*letters([plain(decoding(t)) for t in b.column(1).to_pylist()]), span, size)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row.astype(np.int64))), pa.array(h)], names=["id", "seed"])

        return run

    d = src.mapInArrow(seeds(read), T.StructType([T.StructField("id", out[0].dataType), T.StructField("seed", T.LongType())]))
    i = its.mapInArrow(seeds(lambda t: t), "id long, seed long").withColumnRenamed("id", "item_id").distinct()
    pair = materialise(d.join(i, "seed").select("id", "item_id").distinct())
    both = pair.join(src.select(F.col(doc_id).alias("id"), F.col(text).alias("t")), "id").join(its.select("item_id", F.col("text").alias("item")), "item_id").select("id", "item_id", "t", "item")

    def verify(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            rows = []
            for r in p.itertuples(index=False):
                one = Items([(r.item_id, r.item)], size)
                rows += [(r.id, r.item_id, w, c, v) for _, _, w, c, v in counts(one, one.tiles(*letters([plain(read(r.t))])))]
            yield pd.DataFrame(rows, columns=out.names)

    return both.mapInPandas(verify, out)
