"""Repair of text taken from scanned pages.

1. *Lines*: page-number lines and running headers (the exam's title or a shortening of it) go; words divided by a
   hyphen at a line end are joined, also across such furniture; the rest is joined into paragraphs.
2. *Lexicon*: counts of words, word pairs and ideograph triples over the whole clean part of the corpus.
3. *Candidates*: every scan token that the lexicon lacks is looked up in a symmetric-delete index (strings with up to
   two characters deleted on both sides; for ideographs the triple with its middle deleted). Words for which that index
   is too wide (over LONG letters, as it grows with the square) or too narrow (up to SHORT letters, where two deletions
   leave nothing to tell them by) are looked up by their *skeleton* instead: equal for all words that confusions turn
   into one another. A weighted edit distance in which only confusion pairs are cheap keeps plausible ones.
4. *Choice*: cost, then how often the lexicon has the candidate next to the same neighbour.

Steps 2-4 are joins of counted vocabularies, so they shuffle vocabularies and not texts. The table of repairs is sent to
the workers only while it is under ``max_broadcast_rows``; beyond it the tokens are joined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.arrowtext import codepoints
from quire.llm.canonical import canonical_array
from quire.session import materialise

SCAN_SOURCES = ("flatbed_scan", "phone_scan")

# What a recogniser reads (left) for what is printed (right).
CONFUSIONS = "!=i !=l |=l |=i $=s @=a 0=o 1=l 1=i 5=s 6=b 8=b 9=g 9=q 2=z c=e e=c b=h h=b ii=u u=ii rn=m m=rn h=li li=h cl=d d=cl vv=w w=vv n=ri ri=n f=t t=f l=i i=l a=o o=a u=n n=u v=y y=v"
PAIRS = frozenset(tuple(x.split("=")) for x in CONFUSIONS.split())
#: cost of a confusion that is not a digit within letters, of a digit within letters, and the most a repair may cost
LETTER_COST, DIGIT_COST, MOST = 0.4, 0.2, 0.85

#: words of up to SHORT and of more than LONG letters are found by their skeleton, those up to LONG by deletions
SHORT, LONG = 4, 24
# Skeletons under which both sides of every confusion are equal. A character with no entry stands for itself.
SKELETON = {"i": "1ltfr!|i", "ii": "unhb68", "iii": "m", "o": "ao0@ec", "oi": "d", "s": "s5$", "g": "g9q", "z": "z2", "v": "vy", "vv": "w"}
_SKELETON = str.maketrans({c: k for k, chars in SKELETON.items() for c in chars})

HYPHEN = "-‐‑¬\xad"
_NUM = r"(?:\d{1,4}|[ivxlc]{1,7})"
_HAN = r"[\d一二三四五六七八九十百零〇]{1,6}"
PAGE_LINE = re.compile(
    rf"(?:[-—–·•~|=*]+\s*{_NUM}\s*[-—–·•~|=*]+|[\[【〔<]\s*{_NUM}\s*[\]】〕>]|\d{{1,4}}|\d{{1,4}}\s*[/／|]\s*\d{{1,4}}"
    rf"|(?:p|pp|pg|pág|pag|page|página|pagina|seite|s)\s*[.:]?\s*{_NUM}(?:\s*(?:of|de|von|/)\s*\d{{1,4}})?"
    rf"|[-—–·（(]?\s*第?\s*{_HAN}\s*页(?:\s*[,，、/ ]?\s*共\s*{_HAN}\s*页)?\s*[)）]?\s*[-—–·]?)",
    re.I,
)
WORD = re.compile(r"[^\W_]+")
#: a word; digits and marks that are read for letters may stand in it
TOKEN = re.compile(r"(?:[0-9]*[a-zà-ɏ]+(?:[0-9!|$@]+(?=[a-zà-ɏ]))?)+[0-9]*")
HAN = re.compile("[㐀-鿿]")
BROKEN = re.compile(rf"[^\W\d_][{HYPHEN}]$")
MARKS = np.array([ord(c) for c in ",。;:、()?!"], np.uint32)
_CONTEXT = frozenset(map(int, MARKS))
STARTS_WORD = re.compile(r"[^\W_]")


def is_page_number(line: str) -> bool:
    # blanks are squeezed, so that no pattern has to try where in a run of them to stop
    return PAGE_LINE.fullmatch(" ".join(line.split())) is not None


def is_running_header(line: str, title: str | None) -> bool:
    """The whole title, or a shortening: words of it in its order, or for ideographs its beginning and a later part of it."""
    line = line.strip()
    if not title or not line or len(line) > len(title) + 2:
        return False
    if line == title:
        return True
    a, b = line.casefold(), title.casefold()
    if HAN.search(b):
        if len(a) < 4:
            return False
        return any(b.startswith(a[:k]) and (k == len(a) or (len(a) - k >= 2 and a[k:] in b[k:])) for k in range(2, len(a) + 1))
    x, y = WORD.findall(a), iter(WORD.findall(b))
    return len(x) >= 2 and all(w in y for w in x)


def split_lines(text: str, title: str | None) -> tuple[list[str], set[str]]:
    """Lines that are text, and the kinds of furniture found."""
    kinds: set[str] = set()
    keep = []
    for line in text.split("\n"):
        if is_page_number(line):
            kinds.add("page_number")
        elif is_running_header(line, title):
            kinds.add("running_header")
        else:
            keep.append(line)
    return keep, kinds


def join_lines(lines: list[str]) -> tuple[str, bool]:
    """One continuous text (blank lines stay paragraph breaks), and whether a divided word was joined."""
    out, broken = "", False
    dense = any(map(HAN.search, lines))  # text with ideographs is wrapped anywhere, with no blank lost
    for line in lines:
        if not line.strip():
            out += "\n\n" if out and not out.endswith("\n\n") else ""
        elif not out or out.endswith("\n"):
            out += line
        elif BROKEN.search(out.rstrip(" \t\r")) and STARTS_WORD.match(line.lstrip(" \t")):
            out, broken = out.rstrip(" \t\r")[:-1] + line.lstrip(" \t"), True
        elif dense:
            out += line
        else:
            out += line if out[-1:].isspace() or line[:1].isspace() else " " + line
    return out.strip("\n"), broken


def with_titles(blocks: DataFrame, exams: DataFrame, sources: tuple[str, ...] | None = None) -> DataFrame:
    """blocks and their exam's ``source`` and ``title``.

    A repeated doc_id in exams counts once (the smallest title and source). Where the title is null, the text of the
    exam's first title block (``text_level`` 1) stands in.
    """
    e = exams.groupBy("doc_id").agg(F.min("source").alias("source"), F.min("title").alias("title"))
    if sources:
        e = e.filter(F.col("source").isin(*sources))
    first = blocks.filter((F.col("text_level") == 1) & F.col("content").isNotNull()).join(e.filter("title IS NULL").select("doc_id"), "doc_id", "left_semi")
    first = first.groupBy("doc_id").agg(F.min_by("content", F.struct("block_ord", "block_id")).alias("first_title"))
    e = e.join(first, "doc_id", "left").select("doc_id", "source", F.coalesce("title", "first_title").alias("title"))
    return blocks.join(e, "doc_id")


def _triples(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and counts of (left, ideograph, right); neighbours are ideographs or marks, anything else is 0."""
    cp, off = codepoints(texts)
    if len(cp) < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    han = (cp >= 0x3400) & (cp <= 0x9FFF)
    c = np.where(han | np.isin(cp, MARKS), cp, 0).astype(np.int64)
    left, right = np.concatenate([[0], c[:-1]]), np.concatenate([c[1:], [0]])
    inner = off[:-1][np.diff(off) > 0]
    left[inner] = 0
    right[off[1:][np.diff(off) > 0] - 1] = 0
    return np.unique((left << 42 | c << 21 | right)[han], return_counts=True)


def _key3(k: np.ndarray) -> list[str]:
    m = (1 << 21) - 1
    return [chr(a or 32) + chr(b) + chr(c or 32) for a, b, c in zip((k >> 42).tolist(), (k >> 21 & m).tolist(), (k & m).tolist())]


def _pairs(texts: list[str]) -> Counter:
    count: Counter = Counter()
    for t in texts:
        t = t.lower()
        w = TOKEN.findall(t)
        count.update(zip(["", *w], w))
    return count


VOCAB = T.StructType([T.StructField("kind", T.StringType()), T.StructField("prev", T.StringType()), T.StructField("tok", T.StringType()), T.StructField("n", T.LongType())])


def _count(df: DataFrame, scanned: bool) -> DataFrame:
    """(kind, prev, tok, n): word pairs (kind w) and ideograph triples (kind h); pre-aggregated in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = canonical_array(b.column(0))
            if scanned:
                text = pa.array([join_lines(split_lines(t, h)[0])[0] for t, h in zip(text.to_pylist(), canonical_array(b.column(1)).to_pylist())], pa.string())
            k, n = _triples(text)
            latin = _pairs(text.to_pylist())
            kind = ["h"] * len(k) + ["w"] * len(latin)
            prev = [""] * len(k) + [p for p, _ in latin]
            tok = _key3(k) + [t for _, t in latin]
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(prev, pa.string()), pa.array(tok, pa.string()), pa.array([*n.tolist(), *latin.values()], pa.int64())], names=VOCAB.names)

    return df.select("content", "title").mapInArrow(run, VOCAB).groupBy("kind", "prev", "tok").agg(F.sum("n").alias("n"))


def deletes(word: str, most: int = 2) -> list[str]:
    """The word and all it becomes by deleting up to ``most`` characters (one if short)."""
    out = {word}
    for k in range(1, (most if len(word) > 4 else 1) + 1):
        out.update("".join(word[i] for i in range(len(word)) if i not in drop) for drop in combinations(range(len(word)), k))
    return sorted(out)


def skeleton(word: str) -> str:
    return word.translate(_SKELETON)


def confusion_cost(seen: str, meant: str) -> float:
    """Least cost of turning ``seen`` into ``meant`` by confusion pairs alone; 9 if it can't be done."""
    n, m = len(seen), len(meant)
    cost = [[9.0] * (m + 1) for _ in range(n + 1)]
    cost[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            c = cost[i][j]
            if c >= 2:
                continue
            if i < n and j < m and seen[i] == meant[j] and c < cost[i + 1][j + 1]:
                cost[i + 1][j + 1] = c
            for a in (1, 2):
                for b in (1, 2):
                    if (a, b) != (2, 2) and i + a <= n and j + b <= m and (seen[i : i + a], meant[j : j + b]) in PAIRS:
                        step = c + (LETTER_COST if seen[i].isalpha() else DIGIT_COST)
                        if step < cost[i + a][j + b]:
                            cost[i + a][j + b] = step
    return cost[n][m]


def _index_rows(df: DataFrame) -> DataFrame:
    """(tok, del): each word under the keys by which it can be found."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            rows = [(t, d) for t in p.tok if len(t) <= LONG for d in deletes(t)]
            rows += [(t, "\0" + skeleton(t)) for t in p.tok if not SHORT + 1 < len(t) < LONG - 1]  # a confusion may add or take a letter
            yield pd.DataFrame(rows, columns=["tok", "del"])

    return df.select("tok").mapInPandas(run, "tok string, del string")


def repairs(scan: DataFrame, clean: DataFrame, min_count: int = 3, ratio: int = 10) -> DataFrame:
    """(kind, prev, tok, fix): what to read for a token (after ``prev``) or for the middle of an ideograph triple.

    ``scan`` and ``clean`` have ``content`` and ``title``. A word of two or more letters, however long, is repaired if the clean lexicon has it less than
    ``min_count`` times and a candidate at least ``ratio`` times as often; an ideograph if the lexicon lacks it next to
    both of its neighbours and has a replacement there. Empty inputs give no repairs.
    """
    lex = materialise(_count(clean, False))
    seen = materialise(_count(scan, True))
    # words
    words = lex.filter("kind = 'w'").groupBy("tok").agg(F.sum("n").alias("n"))
    good = words.filter(F.col("n") >= min_count)
    odd = seen.filter("kind = 'w'").filter(F.length("tok") >= 2).join(good.select("tok"), "tok", "left_anti")
    types = odd.filter("tok RLIKE '[^0-9].*[^0-9]'").select("tok").distinct()
    index = _index_rows(good.filter(F.length("tok") >= 2)).withColumnRenamed("tok", "cand")
    near = _index_rows(types).join(index, "del").select("tok", "cand").distinct().filter(F.abs(F.length("tok") - F.length("cand")) <= 2)

    def weigh(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            p["cost"] = [confusion_cost(a, b) for a, b in zip(p.tok, p.cand)]
            yield p[p.cost <= MOST]

    near = near.mapInPandas(weigh, "tok string, cand string, cost double")
    near = near.join(good.select(F.col("tok").alias("cand"), F.col("n").alias("freq")), "cand").join(words.select("tok", F.col("n").alias("own")), "tok", "left").filter(F.col("freq") >= ratio * F.greatest(F.lit(0.3), F.coalesce("own", F.lit(0))))
    pair = lex.filter("kind = 'w'").select("prev", F.col("tok").alias("cand"), F.col("n").alias("together"))
    choice = odd.select("prev", "tok").join(near, "tok").join(pair, ["prev", "cand"], "left").withColumn("together", F.coalesce("together", F.lit(0)))
    best = W.partitionBy("prev", "tok").orderBy(F.col("cost") - 0.1 * F.log1p("together"), F.desc("freq"), "cand")
    latin = choice.withColumn("r", F.row_number().over(best)).filter("r = 1").select(F.lit("w").alias("kind"), "prev", "tok", F.col("cand").alias("fix"), F.lit(0).cast("long").alias("support"))
    # ideographs: delete the middle of the triple, look the frame up, demand that both halves are new and become usual
    tri = lex.filter("kind = 'h'").select(F.substring("tok", 1, 1).alias("l"), F.substring("tok", 2, 1).alias("c"), F.substring("tok", 3, 1).alias("r"), "n")
    lc = tri.groupBy("l", "c").agg(F.sum("n").alias("n_lc"))
    cr = tri.groupBy("c", "r").agg(F.sum("n").alias("n_cr"))
    s = seen.filter("kind = 'h'").select(F.substring("tok", 1, 1).alias("l"), F.substring("tok", 2, 1).alias("c"), F.substring("tok", 3, 1).alias("r"), F.col("n").alias("seen"))
    new = s.filter("l != ' ' OR r != ' '").join(lc, ["l", "c"], "left").join(cr, ["c", "r"], "left").fillna(0, ["n_lc", "n_cr"])
    letter = lambda c: F.col(c).rlike("[㐀-鿿]")
    new = new.filter(~(letter("l") & (F.col("n_lc") > 0)) & ~(letter("r") & (F.col("n_cr") > 0)) & (letter("l") | letter("r")))
    cand = tri.select("l", F.col("c").alias("fix"), "r", F.col("n").alias("n3"))
    # next to a mark it is enough to be far rarer than the replacement
    han = new.join(cand, ["l", "r"]).filter(F.col("fix") != F.col("c"))
    han = han.join(lc.select("l", F.col("c").alias("fix"), F.col("n_lc").alias("m_lc")), ["l", "fix"]).join(cr.select(F.col("c").alias("fix"), "r", F.col("n_cr").alias("m_cr")), ["fix", "r"])
    han = han.filter(((F.col("l") == " ") | (F.col("n_lc") * 5 <= F.col("m_lc"))) & ((F.col("r") == " ") | (F.col("n_cr") * 5 <= F.col("m_cr"))))
    # a confusion counts if it recurs: the sum of its occurrences over all frames, best frame first
    w = W.partitionBy("l", "c", "r").orderBy(F.desc("support"), F.desc("n3"), "fix")
    support = han.groupBy("c", "fix").agg(F.sum("seen").alias("support"))
    han = han.join(support, ["c", "fix"]).filter((F.col("n3") >= min_count) & ((F.col("support") >= 2) | (F.col("n3") >= 50))).withColumn("k", F.row_number().over(w)).filter("k = 1")
    han = han.select(F.lit("h").alias("kind"), F.lit("").alias("prev"), F.concat("l", "c", "r").alias("tok"), "fix", "support")
    return latin.unionByName(han)


def _apply(text: str, fixes: dict, triple: dict) -> tuple[str, bool]:
    """Repair one joined text; fixes by (prev, token), triple by three characters.

    A word of up to SHORT letters with which a text breaks off (no mark follows, or an ellipsis) may be the beginning of a
    longer one, so it is left as it is.
    """
    low = text.lower()
    end = low.rstrip()
    end = len(end.rstrip(".…").rstrip() if end.endswith(("…", "...")) else end)
    out, at, prev, hit = [], 0, "", False
    for m in TOKEN.finditer(low):
        new = fixes.get((prev, m.group()))
        prev = m.group()
        if new is not None and not (m.end() >= end and len(prev) <= SHORT):
            raw = text[m.start() : m.end()]
            out += [text[at : m.start()], new.upper() if raw.isupper() and len(raw) > 1 else new.capitalize() if raw[:1].isupper() else new]
            at, hit = m.end(), True
    out.append(text[at:])
    text = "".join(out)
    if triple and HAN.search(text):
        c = list(text)
        h = [x if HAN.match(x) or ord(x) in _CONTEXT else " " for x in c]
        found = [(i, triple.get((h[i - 1] if i else " ") + x + (h[i + 1] if i + 1 < len(h) else " "))) for i, x in enumerate(h) if x != " "]
        found = [(i, new) for i, new in found if new]
        for k, (i, (new, support)) in enumerate(found):
            # of neighbours that both look odd the better supported one is at fault
            if not any(abs(found[j][0] - i) == 1 and found[j][1][1] > support for j in (k - 1, k + 1) if 0 <= j < len(found)):
                c[i], hit = new, True
        text = "".join(c)
    return text, hit


RESULT = T.StructType([T.StructField("block_id", T.LongType()), T.StructField("repaired", T.StringType()), T.StructField("noise", T.ArrayType(T.StringType()))])


def _clean(text: str, title: str | None, fixes: dict, triple: dict) -> tuple[str, list[str]]:
    lines, kinds = split_lines(text, title)
    joined, broken = join_lines(lines)
    fixed, hit = _apply(joined, fixes, triple)
    return fixed, sorted(kinds | ({"broken_word"} if broken else set()) | ({"misread"} if hit else set()))


def _tokens(text: str, title: str | None) -> set[tuple[str, str, str]]:
    joined = join_lines(split_lines(text, title)[0])[0]
    out = {("w", p, t) for p, t in _pairs([joined])}
    k, _ = _triples(pa.array([joined]))
    return out | {("h", "", t) for t in _key3(k)}


def repair_scanned(blocks: DataFrame, exams: DataFrame, sources: tuple[str, ...] = SCAN_SOURCES, max_broadcast_rows: int = 300_000) -> DataFrame:
    """(block_id, repaired, noise): every text block of a scan source as continuous clean text with its kinds of noise.

    ``noise`` has ``broken_word``, ``misread``, ``page_number``, ``running_header`` in alphabetical order, and is empty
    for clean blocks. Title blocks (``text_level`` 1) and other block types give no row; null content neither; empty
    content comes out empty. Redelivered rows come out once. Columns beyond those used are ignored.
    """
    text = blocks.filter((F.col("block_type") == "text") & (F.length("content") > 0)).withColumn("content", F.regexp_replace("content", "\u00AD[ \t\r]*\n", "-\n"))
    scan = with_titles(text.select("block_id", "doc_id", "content", "text_level", "block_ord"), exams, sources).filter(F.coalesce("text_level", F.lit(0)) != 1).select("block_id", "content", "title")
    other = exams.groupBy("doc_id").agg(F.min("source").alias("source")).filter(~F.coalesce(F.col("source"), F.lit("")).isin(*sources)).select("doc_id")
    clean = text.select("doc_id", "content").join(other, "doc_id").select("content", F.lit(None).cast("string").alias("title"))
    fix = materialise(repairs(scan, clean))
    if fix.count() <= max_broadcast_rows:
        fixes, triple = {}, {}
        for r in fix.toLocalIterator():
            if r.kind == "w":
                fixes[r.prev, r.tok] = r.fix
            else:
                triple[r.tok] = (r.fix, r.support)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [_clean(t, h, fixes, triple) for t, h in zip(canonical_array(b.column(1)).to_pylist(), canonical_array(b.column(2)).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string()))], names=RESULT.names)

        return scan.mapInArrow(run, RESULT).dropDuplicates(["block_id"])

    def keys(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            text, title = canonical_array(pa.array(p.content)).to_pylist(), canonical_array(pa.array(p.title, pa.string())).to_pylist()
            rows = [(i, *k) for i, t, h in zip(p.block_id, text, title) for k in _tokens(t, h)]
            yield pd.DataFrame(rows, columns=["block_id", "kind", "prev", "tok"])

    scan = scan.dropDuplicates(["block_id"])
    mine = scan.mapInPandas(keys, "block_id long, kind string, prev string, tok string").join(fix, ["kind", "prev", "tok"])
    mine = mine.groupBy("block_id").agg(F.collect_list(F.struct("kind", "prev", "tok", "fix", "support")).alias("fixes"))

    def apply(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            text, title = canonical_array(pa.array(p.content)).to_pylist(), canonical_array(pa.array(p.title, pa.string())).to_pylist()
            got = []
            for t, h, f in zip(text, title, p.fixes):
                f = [] if f is None else f
                got.append(_clean(t, h, {(x["prev"], x["tok"]): x["fix"] for x in f if x["kind"] == "w"}, {x["tok"]: (x["fix"], x["support"]) for x in f if x["kind"] == "h"}))
            yield pd.DataFrame({"block_id": p.block_id, "repaired": [g[0] for g in got], "noise": [g[1] for g in got]})

    return scan.join(mine, "block_id", "left").mapInPandas(apply, RESULT)


def scan_noise(blocks: DataFrame, exams: DataFrame, **kw) -> DataFrame:
    """(block_id, noise_kind): one row per kind of noise in a scanned block."""
    return repair_scanned(blocks, exams, **kw).select("block_id", F.explode("noise").alias("noise_kind"))
