"""Subject areas of each message, from labelling functions and a latent model that learns their accuracy.

Labelling functions, each voting per subject:

* *lexicon*: sentences with a term of the subject in the best of the sender's own paragraphs (0, 1, 2, 3 or more);
* *section*: a term of the subject in the Subject line;
* *address* and *source*: the mailbox or source is one whose labelled messages are mostly of the subject.

The lexicon is fitted on a bounded sample of hand-labelled documents (``sample_docs``): each paragraph belongs to one
of its document's subjects, to the background, or is a passed-on exam question; EM finds which. Everything else covers
all documents: paragraphs that recur over the archive (disclaimers, stock phrases) are found by counting all of them, and
the accuracies of the functions and each subject's share are learned by EM from the counts of all vote patterns, of
which there are at most 32 a subject. The posterior of its pattern gives a document its subjects.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.mail import decode_words, own_text, parse, sentences
from quire.session import materialise

TERM = re.compile(r"[a-zà-ɏ]{3,}")
HAN_RUN = re.compile("[㐀-鿿]+")
SAID = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“]*“|«[^»]*»")
DIGITS = re.compile(r"\d+")
#: share of all documents from which a paragraph is stock, and the least count
STOCK_SHARE, STOCK_LEAST = 5e-4, 5
EXAM, NONE = "\x00exam", "\x00none"
LEVELS = 4


def terms(text: str) -> set[str]:
    """Words of three or more letters and pairs of ideographs."""
    text = text.lower()
    out = set(TERM.findall(text))
    for run in HAN_RUN.findall(text):
        out.update(run[i : i + 2] for i in range(len(run) - 1))
    return out


def stock_key(paragraph: str) -> int:
    return xxhash.xxh64_intdigest(DIGITS.sub("9", paragraph)) - 2**63


def topical(paragraphs: list[str]) -> list[tuple[int, list[str]]]:
    """(stock key, sentences without quoted speech) of the paragraphs that have two or more."""
    out = []
    for p in paragraphs:
        s = sentences(SAID.sub(" ", p))
        if len(s) >= 2:
            out.append((stock_key(p), s))
    return out


PARAGRAPHS = "array<struct<key:bigint,sentences:array<string>>>"


def own_paragraphs_of(docs: DataFrame) -> DataFrame:
    """doc_id, mailbox, source, subject line and own paragraphs of every message, parsed once. Narrow."""
    d = docs.select("doc_id", "text", F.lower(F.trim("mailbox")).alias("mailbox"), F.regexp_replace(F.lower(F.trim("source")), "[-\\s]+", "_").alias("source"))
    schema = T.StructType([d.schema["doc_id"], *(T.StructField(c, T.StringType()) for c in ("mailbox", "source", "subject_line")), T.StructField("paragraphs", T._parse_datatype_string(PARAGRAPHS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("key", pa.int64()), ("sentences", pa.list_(pa.string()))]))
        for b in batches:
            head, own = [], []
            for t in b.column(1).to_pylist():
                h, parts = parse(t)
                head.append(decode_words(h.get("subject", "")))
                own.append([{"key": k, "sentences": s} for k, s in topical(own_text(parts))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(head, pa.string()), pa.array(own, kind)], names=schema.names)

    return d.mapInArrow(run, schema)


def stock_paragraphs(own: DataFrame) -> set[int]:
    """Keys of paragraphs that stand in many documents. At most (paragraphs a document) / STOCK_SHARE keys exist."""
    total = own.count()
    n = own.select(F.explode(F.array_distinct(F.transform("paragraphs", lambda p: p["key"]))).alias("key")).groupBy("key").count()
    return {r.key for r in n.filter(F.col("count") >= max(STOCK_LEAST, STOCK_SHARE * total)).collect()}


def fit_lexicon(sample: list[tuple[list[str], set[str]]], exam: list[str], subjects: list[str], rounds: int = 12, alpha: float = 0.05, purity: float = 0.85, least: float = 1.8) -> dict[str, int]:
    """term -> index of its subject. ``sample``: topical paragraphs of a document (joined sentences) and its labels."""
    classes = [*subjects, EXAM, NONE]
    science = subjects.index("science") if "science" in subjects else None
    vocab: dict[str, int] = {}
    par, term, allow = [], [], []

    def add(paragraph: str, labels: set[str]) -> None:
        ok = [c in labels for c in classes]
        if EXAM not in labels:
            ok[-1] = True
            ok[-2] = "science" in labels
        for t in terms(paragraph):
            term.append(vocab.setdefault(t, len(vocab)))
            par.append(len(allow))
        allow.append(ok)

    for paragraphs, labels in sample:
        for p in paragraphs:
            add(p, labels)
    for t in exam:
        add(t, {EXAM})
    if not term or not subjects:
        return {}
    p, t, a, size = np.array(par), np.array(term), np.array(allow), len(vocab)
    prior = np.ones(len(classes))
    prior[-2], prior[-1] = 0.3, 0.2
    r = a * prior
    r /= r.sum(1, keepdims=True)

    def mass() -> np.ndarray:
        return np.stack([np.bincount(t, r[p, c], size) for c in range(len(classes))], 1)

    for _ in range(rounds):
        w = mass()
        logp = np.log((w + alpha) / (w.sum(0) + alpha * size))
        s = np.stack([np.bincount(p, logp[t, c], len(a)) for c in range(len(classes))], 1) + np.log(prior)
        s[~a] = -1e9
        s -= s.max(1, keepdims=True)
        r = np.exp(s)
        r /= r.sum(1, keepdims=True)
    w = mass()
    total = w.sum(1)
    if science is not None:
        w[:, science] += w[:, -2]
    w = w[:, : len(subjects)]
    best = w.argmax(1)
    top = w[np.arange(size), best]
    return {x: int(best[j]) for x, j in vocab.items() if top[j] >= least and top[j] >= purity * total[j]}


def fit_votes(counts: dict[tuple, float], rounds: int = 50) -> tuple[dict[tuple, float], dict]:
    """Posterior of the subject for every vote pattern, by EM over pattern counts with independent functions.

    ``counts``: (lexicon level, section, address, source, label) -> documents; the label is 1 or 0 where annotators have
    spoken and -1 elsewhere. Annotators are a function like the others, with an accuracy to be learned. Unlabelled
    documents together weigh as much as the labelled ones (EM with down-weighted unlabelled data), so that functions
    which only fire for a message's main subject don't redefine what a subject is. Also gives the learned tables.
    """
    pats = list(product(range(LEVELS), (0, 1), (0, 1), (0, 1), (-1, 0, 1)))
    n = np.array([float(counts.get(x, 0.0)) for x in pats])
    vote = np.array(pats)
    known = vote[:, 4] >= 0
    labelled, rest = n[known].sum(), n[~known].sum()
    if labelled:
        n[~known] *= min(1.0, labelled / max(rest, 1.0))
    q = np.where(vote[:, 0] >= 2, 0.9, np.where(vote[:, 0] == 1, 0.2, 0.02))
    q = np.where(vote[:, 4] == 1, np.maximum(q, 0.9), np.where(vote[:, 4] == 0, q * 0.3, q))
    kinds = [LEVELS, 2, 2, 2]
    learned: dict = {}
    for _ in range(rounds):
        like = np.zeros((2, len(pats)))
        learned = {"share": float((n * q).sum() / max(n.sum(), 1e-9))}
        for y, w in enumerate((n * (1 - q), n * q)):
            like[y] = np.log(max(w.sum(), 1e-9) / max(n.sum(), 1e-9))
            for j, k in enumerate(kinds):
                t = np.bincount(vote[:, j], w, k) + 0.5
                t /= t.sum()
                learned[j, y] = t.tolist()
                like[y] += np.log(t[vote[:, j]])
            t = np.bincount(vote[known, 4], w[known], 2) + (np.array([9.0, 1.0]) if y == 0 else np.array([1.0, 9.0]))
            t /= t.sum()
            learned["label", y] = t.tolist()
            free = like[y].copy()
            like[y] += np.where(known, np.log(t[np.maximum(vote[:, 4], 0)]), 0.0)
            learned["free", y] = free
        q = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
    post = 1 / (1 + np.exp(np.clip(learned.pop(("free", 0)) - learned.pop(("free", 1)), -50, 50)))
    return {p[:4]: float(post[k]) for k, p in enumerate(pats) if p[4] == -1}, learned


def _consensus(labels: DataFrame) -> DataFrame:
    """(doc_id, subjects): subjects that any of up to four annotators gave a document, or at least half of more; empty for none.

    Few annotators each mark some of several subjects, so that one alone is right more often than not; against many, one is an outlier.
    """
    each = labels.filter("doc_id IS NOT NULL AND subject IS NOT NULL").select("doc_id", "subject", F.coalesce("annotator", F.lit(-1)).alias("annotator")).distinct()
    total = each.groupBy("doc_id").agg(F.count_distinct("annotator").alias("all"))
    kept = each.groupBy("doc_id", "subject").agg(F.count("*").alias("k")).join(total, "doc_id").filter("2 * k >= all OR all <= 4")
    return kept.groupBy("doc_id").agg(F.collect_set(F.when(F.col("subject") != "none", F.col("subject"))).alias("subjects"))


def _majority(sample: list, column: int, subjects: list[str]) -> dict:
    """Mailbox or source -> subject index, where at least half of five or more labelled messages have the subject."""
    seen: dict = defaultdict(Counter)
    docs: Counter = Counter()
    for row in sample:
        if row[column]:
            docs[row[column]] += 1
            seen[row[column]].update(row[1])
    out = {}
    for key, c in seen.items():
        for s, k in c.most_common(1):
            if docs[key] >= 5 and 2 * k >= docs[key]:
                out[key] = subjects.index(s)
    return out


def subject_votes(docs: DataFrame, labels: DataFrame, areas: DataFrame, items: DataFrame | None = None, sample_docs: int = 8000, sample_items: int = 2000) -> tuple[DataFrame, list[str], dict]:
    """(votes, subjects, labelled): doc_id, subject, level, section, address, source_vote and label for every document and
    subject with at least one vote; ``labelled`` has the sample's (label 0, label 1) documents by subject.

    The lexicon is fitted on at most ``sample_docs`` labelled documents and ``sample_items`` exam texts, those of least hash.
    """
    subjects = [r.subject for r in areas.select("subject").filter("subject IS NOT NULL").distinct().orderBy("subject").collect()]
    d = materialise(own_paragraphs_of(docs))
    stock = stock_paragraphs(d)
    chosen = materialise(_consensus(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
    # the sample is bounded, so its paragraphs may come to the driver
    rows = d.join(F.broadcast(chosen), "doc_id").select("paragraphs", "subjects", "mailbox", "source").collect()
    sample = [(["\n".join(p.sentences) for p in r.paragraphs if p.key not in stock], {s for s in r.subjects if s in subjects}, r.mailbox, r.source) for r in rows]
    exam = [r.text for r in items.select("text").filter("text IS NOT NULL").distinct().orderBy(F.xxhash64("text"), "text").limit(sample_items).collect()] if items is not None else []
    lexicon = fit_lexicon([x[:2] for x in sample], exam, subjects)
    by_box, by_source = _majority(sample, 2, subjects), _majority(sample, 3, subjects)

    def hit(text: str) -> set[int]:
        text = text.lower()
        out = {lexicon[w] for w in TERM.findall(text) if w in lexicon}
        for run in HAN_RUN.findall(text):
            out.update(lexicon[run[i : i + 2]] for i in range(len(run) - 1) if run[i : i + 2] in lexicon)
        return out

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("subject", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("section", T.IntegerType()), T.StructField("address", T.IntegerType()), T.StructField("source_vote", T.IntegerType())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for k, (box, src, line, paragraphs) in enumerate(zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)))):
                best = [0] * len(subjects)
                for para in paragraphs:
                    if para["key"] not in stock:
                        here = Counter(s for x in para["sentences"] for s in hit(x))
                        for s, n in here.items():
                            best[s] = max(best[s], n)
                section = hit(line)
                for s in range(len(subjects)):
                    v = (min(best[s], LEVELS - 1), int(s in section), int(by_box.get(box) == s), int(by_source.get(src) == s))
                    if any(v):
                        for c, x in zip(cols, (k, subjects[s], *v)):
                            c.append(x)
            arrays = [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int32()) for c in cols[2:])]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    votes = d.select("doc_id", "mailbox", "source", "subject_line", "paragraphs").mapInArrow(vote, schema)
    # at most sample_docs rows
    votes = votes.join(F.broadcast(chosen), "doc_id", "left").select(*schema.names, F.when(F.isnull("subjects"), -1).otherwise(F.array_contains("subjects", F.col("subject")).cast("int")).alias("label"))
    yes = Counter(x for r in sample for x in r[1])
    return votes, subjects, {x: (len(sample) - yes[x], yes[x]) for x in subjects}


def document_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, items: DataFrame | None = None, sample_docs: int = 8000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, subject, probability): the subjects whose posterior reaches ``threshold``.

    A document has none, one or several rows. Null and empty text has none; without labels the lexicon is empty but for
    the exam terms of ``items``. A repeated doc_id gives its rows again. Labels of unknown documents or subjects are
    ignored. Columns beyond those used are ignored.
    """
    votes, subjects, labelled = subject_votes(docs, labels, areas, items, sample_docs)
    votes = materialise(votes)
    total = docs.count()
    pattern = ["level", "section", "address", "source_vote"]
    counts: dict[str, Counter] = {s: Counter() for s in subjects}
    for r in votes.groupBy("subject", *pattern, "label").count().collect():  # at most 96 a subject
        counts[r.subject][r.level, r.section, r.address, r.source_vote, r.label] = r["count"]
    rows = []
    for s, c in counts.items():
        seen = {x: sum(n for k, n in c.items() if k[4] == x) for x in (-1, 0, 1)}
        silent = (0, 0, 0, 0)
        c[(*silent, 0)], c[(*silent, 1)] = (max(0, labelled[s][x] - seen[x]) for x in (0, 1))
        c[(*silent, -1)] = max(0, total - sum(labelled[s]) - seen[-1])
        rows += [(s, *p, q) for p, q in fit_votes(c)[0].items() if q >= threshold and any(p)]
    post = docs.sparkSession.createDataFrame(rows, "subject string, level int, section int, address int, source_vote int, probability double")
    return votes.join(F.broadcast(post), ["subject", *pattern]).select("doc_id", "subject", "probability")
