"""An exact join of similar sets, whose use of disk is in proportion to the sets.

Every record is the set of its distinct shingles, hashed to 50 bits (``distinct``). The shingles have one order, rarest first
(``shingle_order``). If two sets are similar enough, the first shingle they share stands early in both: among the first
n - ceil(2t / (1 + t) * n) + 1 of the smaller one (a quarter of it at a threshold t of 0.6) and the first m - ceil(t * m) + 1
of the larger (``prefix_lengths``), and for two given sizes earlier still (``meet``). These bounds hold for every pair, so
none is missed at any size or similarity.

Records are put into groups of near sizes, and each two groups whose sizes allow similar pairs meet in one task. Every
record is written once, into the folder of its group, and a task reads the folders of its two groups: the number of
groups changes how often a record is read, never how much is shuffled or stored. Pairs that meet must pass, in the same
task, a parity sketch of SKETCH_BITS bits, whose Hamming distance can't exceed the symmetric difference that the
threshold allows. Only what is left goes on to be verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.arrowtext import byte_view, owners
from quire.session import materialise, read_part

#: width of a record's parity sketch
SKETCH_BITS = 1024
#: rows handled at once; with 50 bits of hash they fit one word
ROWS = 8192
#: bytes of a shingle's hash that are stored; equal ones of different shingles only cost a comparison
TOKEN_BYTES = 3
#: first bits of a shingle's hash that make its class; the rarest classes come first in the order
CLASS_BITS = 18
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: (hashes, offsets): the distinct shingles of every text, sorted within the row; classes replaced by their rank if there is one
Sets = Callable[[pa.Array, np.ndarray | None], tuple[np.ndarray, np.ndarray]]


def mix(a: np.ndarray, seed: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        a = (a + np.uint64(seed % 2**63)) * M1
        a ^= a >> np.uint64(30)
        a *= M2
        a ^= a >> np.uint64(27)
        a *= M3
        return a ^ (a >> np.uint64(31))


def distinct(v: np.ndarray, own: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): the distinct values of every row, sorted; ``v`` has 50 bits and ``own`` the row of each, ascending."""
    # row and value in one word, so that a plain sort does
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo in range(0, rows, ROWS):
        a, b = np.searchsorted(own, [lo, lo + ROWS])
        x = np.sort((own[a:b] - np.uint64(lo)) << np.uint64(50) | v[a:b])
        x = x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
        parts.append(x & np.uint64((1 << 50) - 1))
        sizes.append(np.bincount((x >> np.uint64(50)).astype(np.int64), minlength=min(ROWS, rows - lo)))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def ranked(h: np.ndarray, rank: np.ndarray | None) -> np.ndarray:
    """Hashes of 50 bits with the class replaced by its rank (see shingle_order), so that the rarest come first."""
    if rank is None:
        return h
    low = np.uint64(50 - CLASS_BITS)
    return rank[(h >> low).astype(np.int64)] << low | h & ((np.uint64(1) << low) - np.uint64(1))


def shingle_order(text: DataFrame, sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, sizes, records): rank of each class of shingles (their first CLASS_BITS bits), rarest first, and how many records have each size.

    Any order makes the join exact; the rarest first makes it fast. Both counts come from one pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = np.zeros(1 << CLASS_BITS, np.int64), np.zeros(1, np.int64)
        for b in batches:
            h, off = sets(b.column(0), None)
            held += np.bincount((h >> np.uint64(50 - CLASS_BITS)).astype(np.int64), minlength=1 << CLASS_BITS)
            more = np.bincount(np.diff(off), minlength=len(sizes))
            more[: len(sizes)] += sizes
            sizes = more
        for kind, c in enumerate((held, sizes)):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(c[at])], names=["kind", "at", "n"])

    got = text.select("text").mapInArrow(run, "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    kind, at, n = (got.column(i).to_numpy() for i in range(3))
    held = np.zeros(1 << CLASS_BITS, np.int64)
    held[at[kind == 0]] = n[kind == 0]
    rank = np.empty(1 << CLASS_BITS, np.uint64)
    rank[np.argsort(held, kind="stable")] = np.arange(1 << CLASS_BITS, dtype=np.uint64)
    at, n = at[(kind == 1) & (at > 0)], n[(kind == 1) & (at > 0)]
    o = np.argsort(at)
    return rank, at[o], n[o]


def size_groups(sizes: np.ndarray, records: np.ndarray, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(first, parts, pairs): for each size its first group and over how many it is spread, so that a group has about ``most`` shingles; and the pairs of groups that may hold similar sets."""
    first, parts, low, high = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), [], []
    room = 0
    for i, (size, n) in enumerate(zip(sizes.tolist(), records.tolist())):
        if n * size > room:
            parts[i] = min(n, -(-n * size // most))
            low += [size] * int(parts[i])
            high += [size] * int(parts[i])
            room = most if parts[i] == 1 else 0
        first[i] = len(low) - parts[i]
        high[-1] = size
        room -= n * size
    return first, parts, [(g, j) for g in range(len(low)) for j in range(g, len(low)) if high[g] >= threshold * low[j] - 1e-6]


def prefix_lengths(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(short, long): how many of its first shingles a set needs against sets no smaller, and against sets no larger than itself."""
    short = n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + 1
    return np.where(n > 0, short, 0), np.where(n > 0, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0)


def cut(flat: np.ndarray, off: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` elements of every row of a ragged array."""
    at = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(off[:-1] - at[:-1], size) + np.arange(at[-1])], at


def meet(left: tuple, right: tuple | None, threshold: float, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches (i, j) of distinct pairs of rows of ``left`` and ``right`` (None: i < j of left) that may be similar.

    Each side is (n, tokens, offsets) with n ascending; no row of ``left`` is larger than one of ``right``. If sets of n and
    m shingles share at least a = threshold / (1 + threshold) * (n + m), the first one they share stands among the first
    n - a + 1 and m - a + 1: a meeting beyond either place isn't followed. About ``most`` meetings are held at a time.
    """
    share = threshold / (1 + threshold)

    def reach(n: np.ndarray, own: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The largest other set for which each place in a prefix is early enough."""
        return np.floor((n[own] - (np.arange(len(own)) - off[own])) / share - n[own] + 1e-6).astype(np.int64)

    n, tok, off = left
    pn, ptok, poff = right or left
    tok, off = cut(tok, off, np.minimum(np.diff(off), prefix_lengths(n, threshold)[0]))
    own = owners(off)
    # places of a token in the order of their reach, so that those too late for a probe aren't touched
    code = tok.astype(np.uint64) << np.uint64(32) | np.minimum(reach(n, own, off), 2**32 - 1).astype(np.uint64)
    o = np.argsort(code)
    code, own, bits = code[o], own[o].astype(np.uint32 if len(n) < 2**32 else np.uint64), len(n).bit_length()
    for first in range(0, len(pn), ROWS):
        m = pn[first : first + ROWS]
        at = poff[first : first + ROWS + 1]
        ptoken, at = ptok[at[0] : at[-1]], at - at[0]
        j = owners(at)
        end = np.searchsorted(n, reach(m, j, at), "right")
        if right is None:
            end = np.minimum(end, first + j)
        o = np.argsort(ptoken)  # searching in order is many times faster
        key = ptoken[o].astype(np.uint64) << np.uint64(32)
        lo, count = np.zeros(len(o), np.int64), np.zeros(len(o), np.int64)
        lo[o] = np.searchsorted(code, key | m[j[o]].astype(np.uint64))
        count[o] = np.searchsorted(code, key | np.uint64(2**32 - 1), "right")
        count -= lo
        live = np.flatnonzero((count > 0) & (end > 0))
        lo, count, j, end = lo[live], count[live], j[live], end[live]
        row = np.searchsorted(j, np.arange(len(m) + 1))  # the places of each probing row
        total = np.concatenate([[0], np.cumsum(count)])[row]  # meetings before each row
        done = 0
        while done < len(m):
            # as many whole rows as make up about ``most`` meetings, one at least
            stop = max(done + 1, int(np.searchsorted(total, total[done] + most, "right")) - 1)
            a, z = row[done], row[stop]
            k = count[a:z]
            if k.sum():
                i = own[np.repeat(lo[a:z] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                # both rows in one number, of 32 bits where that holds them
                wide = np.uint32 if (stop - done) << bits < 2**32 else np.uint64
                pair = np.repeat((j[a:z] - done).astype(wide) << wide(bits), k) | i.astype(wide, copy=False)
                pair = np.sort(pair[i < np.repeat(end[a:z].astype(own.dtype), k)])  # unique() hashes, which is slower
                if len(pair):
                    pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])]
                    yield (pair & wide((1 << bits) - 1)).astype(np.int64), first + done + (pair >> wide(bits)).astype(np.int64)
            done = stop


def parity_bits(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, SKETCH_BITS / 8) bytes: the parity of the shingles that hash to each bit. Differing bits <= differing shingles."""
    n = len(off) - 1
    out = np.zeros((n, SKETCH_BITS // 8), np.uint8)
    bit = (mix(h, 99_991) % np.uint64(SKETCH_BITS)).astype(np.int64)
    for lo in range(0, n, 1000):
        hi = min(n, lo + 1000)
        own = np.repeat(np.arange(hi - lo), np.diff(off[lo : hi + 1]))
        at = np.sort((own * SKETCH_BITS + bit[off[lo] : off[hi]]).astype(np.uint32))
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        odd = np.diff(np.concatenate([start, [len(at)]])) % 2 == 1
        flat = np.zeros((hi - lo) * SKETCH_BITS, bool)
        flat[at[start[odd]]] = True
        out[lo:hi] = np.packbits(flat.reshape(hi - lo, SKETCH_BITS), axis=1)
    return out


def sketch_words(largest: int, threshold: float) -> int:
    """Words of 64 bits with which sketches of sets up to this size tell most unlike sets apart: 4, 8 or 16."""
    bits = 2.3 * (1 - threshold) / (1 + threshold) * 2 * largest
    return next((w for w in (4, 8) if bits <= 64 * w), SKETCH_BITS // 64)


def ragged(rows: tuple[np.ndarray, np.ndarray], width: int) -> pa.Array:
    """A binary column of ragged rows, whose elements have ``width`` bytes."""
    flat, off = rows
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * width).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parity sketches of fewer bits: the halves of one XORed are a sketch as well."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return np.ascontiguousarray(bits)


def near(x: dict[int, np.ndarray], y: dict[int, np.ndarray], m: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) the parity sketches don't rule out; x, y have those of sets of m, n shingles, by their words.

    A sketch is a column of words, so that a word's array stays in the cache. Where the sets are small a folded sketch rules
    most pairs out, and the whole one is asked only of the rest.
    """
    apart = (1 - threshold) / (1 + threshold)
    ok = np.zeros(len(i), bool)
    for lo in range(0, len(i), 32768):
        a, b = i[lo : lo + 32768], j[lo : lo + 32768]
        most = apart * (m[a] + n[b]) + 1e-9
        left = np.arange(len(a))
        for words in sorted(x):
            if words * 64 >= 2.3 * most.max() or words == max(x):
                p, q, differ = a[left], b[left], np.zeros(len(left), np.uint16)
                for u, v in zip(x[words], y[words]):
                    differ += np.bitwise_count(u[p] ^ v[q])
                left = left[differ <= most[left]]
        ok[lo + left] = True
    return ok


def candidates(rep: DataFrame, sets: Sets, threshold: float, group: int = 25_000_000) -> DataFrame:
    """(a, b), a < b, distinct: pairs of ids of ``rep`` (id, text) whose ``sets`` may be similar by ``threshold``; none that is similar is missed.

    Empty sets are in no pair. A repeated id may have several texts. ``group`` is how many shingles of records a task
    compares with as many others; it doesn't change which similar pairs are found.
    """
    spark, kind = rep.sparkSession, rep.schema["id"].dataType
    pair = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    rank, sizes, records = shingle_order(rep, sets)
    first, parts, tasks = size_groups(sizes, records, threshold, group)
    if not tasks:
        return spark.createDataFrame([], pair)
    largest = np.zeros(1 + max(j for _, j in tasks), np.int64)
    np.maximum.at(largest, np.concatenate([first, first + parts - 1]).astype(np.int64), np.concatenate([sizes, sizes]))
    words = [sketch_words(int(largest[j]), threshold) for _, j in tasks]
    # a group keeps the widest sketch that one of its tasks asks for
    wide = np.zeros(len(largest), np.int64)
    for (g, j), w in zip(tasks, words):
        wide[[g, j]] = np.maximum(wide[[g, j]], w)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, off = sets(b.column(1), rank)
            tok = mix(v, 77_777)
            n = np.diff(off)
            bits = parity_bits(v, off)
            rows = np.flatnonzero(n)
            which = np.searchsorted(sizes, n[rows])
            g = first[which] + (mix(v[off[:-1][rows]], 55) % parts[which].astype(np.uint64)).astype(np.int64)
            long = prefix_lengths(n, threshold)[1]
            for x in np.unique(g).tolist():
                r = rows[g == x]
                flat, at = cut(tok, np.concatenate([off[:-1][r], [0]]), long[r])
                mine = ragged((np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]), at), TOKEN_BYTES)
                w = int(wide[x])
                sk = ragged((folded(bits[r].view(np.uint64), w), np.arange(len(r) + 1)), 8 * w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), x, np.int64)), b.column(0).take(pa.array(r)), pa.array(n[r]), mine, sk], names=["part", "id", "n", "tok", "bits"])

    signed = T.StructType([T.StructField("part", T.LongType()), T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("tok", T.BinaryType()), T.StructField("bits", T.BinaryType())])
    # each task writes a file a group: nothing is shuffled
    files: dict[int, list[str]] = {}
    for path in materialise(rep.select("id", "text").mapInArrow(sign, signed), by="part").inputFiles():
        files.setdefault(int(path.rpartition("/part=")[2].partition("/")[0]), []).append(path)

    def side(g: int, w: int) -> tuple:
        s = pa.concat_tables([read_part(p, ["id", "n", "tok", "bits"]) for p in files.get(g, [])]).combine_chunks()
        s = s.take(pa.array(np.argsort(s["n"].to_numpy(), kind="stable")))
        raw, off = byte_view(s["tok"].combine_chunks().cast(pa.large_binary()))
        bits = folded(np.frombuffer(byte_view(s["bits"].combine_chunks().cast(pa.large_binary()))[0], np.uint64).reshape(len(s), -1), w)
        tok = np.zeros((len(raw) // TOKEN_BYTES, 4), np.uint8)
        tok[:, :TOKEN_BYTES] = raw.reshape(-1, TOKEN_BYTES)
        return s["id"], {x: np.ascontiguousarray(folded(bits, x).T) for x in (4, 8, 16) if x <= w}, (s["n"].to_numpy(), tok.view(np.uint32).ravel(), np.asarray(off) // TOKEN_BYTES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (t for b in batches for t in b.column(0).to_pylist()):
            g, j = tasks[task]
            # a group of which chance has left all parts empty has no files
            if g not in files or j not in files:
                continue
            x = side(g, words[task])
            y = x if g == j else side(j, words[task])
            for a, b in meet(x[2], None if g == j else y[2], threshold):
                ok = near(x[1], y[1], x[2][0], y[2][0], a, b, threshold)
                if ok.any():
                    both = [c.take(pa.array(i[ok])).combine_chunks() for c, i in ((x[0], a), (y[0], b))]
                    yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in both], names=["a", "b"])

    met = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(compare, pair)
    less = F.col("a") < F.col("b")
    # a repeated id may have two texts that are alike
    return materialise(met.filter("a != b").select(F.when(less, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("b")).distinct())
