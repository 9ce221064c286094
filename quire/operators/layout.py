"""Ranges of single- and multiple-answer questions from an exam's headers, and tagging by them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import rx

# Words that announce each kind as a heading, words that do so only at the beginning of a line, words that tell
# it after a range, and what may join the two numbers of a range.
HEADS = {"multi": ("多项选择题", "多选题"), "single": ("单项选择题", "单选题")}
LINE_HEADS = {"multi": ("多选", "多项"), "single": ("单选", "单项")}
TELLS = {"single": ("只有一项", "单项", "只有1项", "只有一个"), "multi": ("有多项", "多项", "有多个")}
JOINS = ("\\~", "--", "-", "—", "–", "~", "至")
PAGES = 5
#: characters between two headings of a kind that count as one; how far a range may stand after and before its heading; how far
#: a tell-tale may stand after its range; the longest of two adjoining ranges and the widest gap between them
SAME, AFTER, BEFORE, TELL, LONGEST, GAP = 20, 250, 30, 24, 30, 5
_NUMBERING = "0123456789一二三四五、,.． \t"


class Found(NamedTuple):
    """A heading (kind) or a range (first, last) between two places of a text."""

    start: int
    end: int
    kind: str = ""
    first: int = 0
    last: int = 0


def _ranges(text: str) -> list[Found]:
    """Two numbers of 1 to 50 in order with nothing but a join between them."""
    numbers = [m for m in re.finditer("[0-9]+", text) if m.end() - m.start() <= 2]
    pairs = [(a, b) for a, b in zip(numbers, numbers[1:]) if text[a.end() : b.start()].strip() in JOINS]
    return [Found(a.start(), b.end(), "", int(a[0]), int(b[0])) for a, b in pairs if 1 <= int(a[0]) <= int(b[0]) <= 50]


def _headings(text: str) -> list[Found]:
    """Headings in order; where both kinds begin at one place it is the multiple one, and a kind repeated at once counts once."""
    found = {}
    for kind in ("single", "multi"):
        for words, anywhere in ((HEADS[kind], True), (LINE_HEADS[kind], False)):
            for m in re.finditer(rx.any_of(words), text):
                line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
                if anywhere or not line.strip(_NUMBERING):
                    longer = found.get(m.start())
                    found[m.start()] = Found(m.start(), max(m.end(), longer.end if longer and longer.kind == kind else 0), kind)
    heads = [found[k] for k in sorted(found)]
    return [h for before, h in zip([None, *heads], heads) if before is None or before.kind != h.kind or h.start - before.end >= SAME]


def ranges_in(text: str) -> dict[str, tuple[int, int]]:
    """{kind: (first, last)} of one page's text.

    A heading takes the first range up to the next heading, at most AFTER characters on, else one just before it; the first
    heading of a kind that has one counts. For kinds still open a range counts that is followed by a tell-tale in its
    sentence. Without any of these two adjoining ranges of question numbers are the single and the multiple ones.
    """
    ranges, heads = _ranges(text), _headings(text)
    out: dict[str, tuple[int, int]] = {}
    for h, following in zip(heads, [*(x.start for x in heads[1:]), len(text)]):
        near = [r for r in ranges if h.end <= r.start and r.end <= min(h.end + AFTER, max(following, h.end))]
        near += [r for r in ranges if h.start - BEFORE <= r.start and r.end <= h.start]
        if near:
            out.setdefault(h.kind, (near[0].first, near[0].last))
    for r in ranges:
        clause = re.split("[。\n]", text[r.end :], maxsplit=1)[0][: TELL + 1]
        places = {k: min((clause.find(w) for w in words if w in clause), default=None) for k, words in TELLS.items()}
        told = sorted((at, k) for k, at in places.items() if at is not None)
        if told:
            out.setdefault(told[0][1], (r.first, r.last))
    if not out:
        named = [r for r in ranges if text[r.end :].lstrip().startswith("题") and r.last - r.first <= LONGEST]
        if len(named) >= 2 and 0 < named[1].first - named[0].last <= GAP:
            out = {"single": (named[0].first, named[0].last), "multi": (named[1].first, named[1].last)}
    return out


def page_layout(pages: DataFrame, max_pages: int = PAGES) -> DataFrame:
    """(doc_id, page_idx, kind, qnum): the question numbers that a document's first pages announce as single or multi.

    ``pages``: doc_id, page_idx, text. Null and empty texts announce nothing.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            rows = [(d, i, k, n) for d, i, t in zip(p.doc_id, p.page_idx, p.text) for k, (a, b) in ranges_in(t).items() for n in range(a, b + 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_idx", "kind", "qnum"])

    few = pages.filter((F.col("page_idx") < max_pages) & (F.length("text") > 0)).select("doc_id", "page_idx", "text")
    return few.mapInPandas(run, "doc_id string, page_idx int, kind string, qnum int").distinct()


def tag_multi_select(questions: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """questions with ``multi_tag``: what the layout says of its page and number (multi before single), else what the section's
    title says, else null."""
    title = F.coalesce("section_title", F.lit(""))
    by_title = F.when(title.rlike("多选|多项"), True).when(title.rlike("单选|单项"), False)
    if layout is None:
        return questions.withColumn("multi_tag", by_title)
    kind = layout.groupBy("doc_id", F.col("page_idx").alias("source_page"), F.col("qnum").alias("q_index")).agg(F.max(F.col("kind") == "multi").alias("__multi"))
    return questions.join(kind, ["doc_id", "source_page", "q_index"], "left").withColumn("multi_tag", F.coalesce("__multi", by_title)).drop("__multi")


def split_pages(md: DataFrame) -> DataFrame:
    """(doc_id, page_idx, text): Markdown cut at marks ``P3L``, else at form feeds, else at three or more line ends."""
    t = F.col("md")
    parts = F.when(t.rlike(f"\\n{rx.S}*P[0-9]+[LR]{rx.S}*\\n"), F.split(t, f"\\n{rx.S}*P[0-9]+[LR]{rx.S}*\\n")).when(t.contains("\f"), F.split(t, "\f")).otherwise(F.split(t, "\\n{3,}"))
    return md.select("doc_id", F.posexplode(parts).alias("page_idx", "text"))
