"""Near-duplicates, evaluation leaks, mixing and subjects: brute force, held-out accuracy, odd inputs."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import leak, mail, mixing, neardup, topics
from quire.session import table
from tests.conftest import SMALL

MIDDLE, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def sets(text, k=5):
    return {text[i : i + k] for i in range(len(text) - k + 1)}


def test_sketch_bounds():
    rnd = random.Random(2)
    a = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 400))) for _ in range(60)]
    b = [x[: len(x) // 2] + "".join(rnd.choice("xyz") for _ in range(9)) + x[len(x) // 2 :] for x in a]
    x, xo = neardup.shingles(pa.array(a), 5)
    y, yo = neardup.shingles(pa.array(b), 5)
    assert np.diff(xo).tolist() == [len(sets(t)) for t in a]
    apart = np.bitwise_count(neardup.parity_bits(x, xo) ^ neardup.parity_bits(y, yo)).sum(axis=1)
    assert all(h <= len(sets(s) ^ sets(t)) for h, s, t in zip(apart, a, b))
    want = [len(sets(s) & sets(t)) / max(1, len(sets(s) | sets(t))) for s, t in zip(a, b)]
    assert np.allclose(neardup.jaccard_rows(pa.array(a), pa.array(b), 5), want)


def test_similar_questions_recall(spark):
    got = {(r[0], r[1]) for r in neardup.similar_questions(table(spark, MIDDLE, "questions"), table(spark, MIDDLE, "blocks")).collect()}
    texts = {r.question_id: r.text for r in neardup.question_texts(table(spark, MIDDLE, "questions"), table(spark, MIDDLE, "blocks")).collect()}
    s = {k: sets(v) for k, v in texts.items()}
    index: dict[str, list] = {}
    for k, v in s.items():
        for x in v:
            index.setdefault(x, []).append(k)
    cand = {p for ids in index.values() if len(ids) <= 40 for p in itertools.combinations(sorted(ids), 2)}
    want = {(a, b) for a, b in cand if len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])}
    assert got <= want | got and not got - want and len(want - got) <= 0.005 * len(want)


def test_question_texts(spark):
    q = spark.createDataFrame([("d", 0, 1, "Q 1"), ("d", 0, 1, "Q 1"), ("d", 1, 2, None), ("d", None, 3, "x"), (None, 0, 4, "y")], "doc_id string, q_ord int, question_id long, label string")
    b = spark.createDataFrame([("d", 0, 5, 2, "text", "B b"), ("d", 0, 5, 2, "text", "B b"), ("d", 0, 6, 1, "text", "A　"), ("d", 0, 7, 0, "image", "no"), ("d", None, 8, 0, "text", "no"), ("d", 9, 9, 0, "text", "no")], "doc_id string, q_ord int, block_id long, block_ord int, block_type string, content string")
    got = {r.question_id: r.text for r in neardup.question_texts(q, b.withColumns({"text": F.lit(1), "label": F.lit("z")})).collect()}
    assert got == {1: "q1abb", 2: "", 3: "x", 4: "y"}


def test_copies_and_odd_texts(spark):
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdefghij") for _ in range(300))
    rows = [(1, base), (2, base), (2, base), (3, base[:150] + "zz" + base[150:]), (4, ""), (5, None), (6, "abc"), (7, "abc"), (8, "q" * 300_000)]
    df = spark.createDataFrame(rows, "id long, text string").withColumns({"h1": F.lit(1), "rep": F.lit(2)})
    pairs, copies = neardup.similar_pairs(df, "id", "text")
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 3)}
    assert {(r.id, r.rep) for r in copies.collect()} == {(1, 1), (2, 1), (4, 4), (5, 4), (6, 6), (7, 6)}
    assert neardup.similar_pairs(df.limit(0), "id", "text")[0].count() == 0


def test_no_pair_is_missed(spark):
    rnd = random.Random(6)
    rows = []
    for size in (6, 9, 14, 24, 54, 104, 204, 304):
        for _ in range(12):
            base = [rnd.choice("abcdefghijklmnop") for _ in range(size)]
            near = ["".join(base)]
            for _ in range(3):
                t = list(base)
                for _ in range(rnd.randint(1, size // 25) if size > 49 else size // 14):
                    t[rnd.randrange(size)] = rnd.choice("xyz")
                near.append("".join(t) + "w" * rnd.randint(0, max(1, size // 9)))
            rows += near
    rows = list(enumerate(dict.fromkeys(rows)))
    s = {i: sets(t) for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(s, 2) if len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])}
    assert len(want) > 100 and any(len(s[a]) < 5 for a, _ in want)
    df = spark.createDataFrame(rows, "id long, text string")
    for kw in ({}, {"group": 3000}):
        assert {(r.a, r.b) for r in neardup.similar_pairs(df, "id", "text", **kw)[0].collect()} == want


PASSAGE = "a coated gasket of mass 57.35 kg rests on a narrow trench beside a magnetised sled and the paddle discharges rapidly for seconds"


def mails():
    import base64

    wrapped = "\n> ".join(PASSAGE.split(" "))
    return [
        (1, f"Subject: x\n\nHi,\n> {wrapped}\nbye"),
        (2, "Subject: x\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(f"see {PASSAGE.upper()}!".encode()).decode()),
        (3, 'Subject: x\nContent-Type: multipart/mixed;\n boundary="b"\n\n--b\nContent-Type: text/html\nContent-Transfer-Encoding: quoted-printable\n\n<p>' + PASSAGE.replace("mass", "ma<b>ss</b>").replace("narrow", "nar=\nrow") + "</p>"),
        (4, "Subject: x\n\n" + " ".join(PASSAGE.split()[:12]) + " end"),
        (5, ""), (6, None), (7, "Subject: y\r\n\r\n" + PASSAGE.replace(" ", "\r\n")), (8, "w " * 200_000),
        (9, "Subject: z\n\n已知弹簧的电阻是四十七千克，电容器的弹力\n大小是二十三米每秒。物体纸带受摩擦力五牛"),
    ]


ITEMS = [(100, PASSAGE), (100, PASSAGE), (101, "已知弹簧的电阻是四十七千克电容器的弹力大小是二十三米每秒物体纸带受摩擦力"), (102, ""), (103, None), (104, "short")]


def test_leaks(spark):
    d = spark.createDataFrame(mails(), "doc_id long, text string").withColumns({"item_id": F.lit(5), "words": F.lit(1)})
    i = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(3))
    near = {(r.doc_id, r.item_id) for r in leak.eval_leaks(d, i).collect()}
    assert near == {(1, 100), (2, 100), (3, 100), (7, 100), (9, 101)}
    assert {(r.doc_id, r.item_id) for r in leak.eval_leaks(d, i, max_broadcast_chars=-1).collect()} == near
    assert leak.eval_leaks(d.limit(0), i).count() == 0 and leak.eval_leaks(d, i.limit(0)).count() == 0


def test_leaks_brute(spark):
    docs = {r.doc_id: re.findall(r"[^\W_]+", leak.plain(mail.all_text(r.text))) for r in table(spark, SMALL, "documents").collect()}
    items = [(r.item_id, r.lang, re.findall(r"[^\W_]+", leak.plain(r.text))) for r in table(spark, SMALL, "eval_items").collect()]
    want = set()
    for k, w in docs.items():
        s, n = "".join(w), " " + " ".join(w) + " "
        for i, lang, v in items:
            parts = [" " + " ".join(v[j : j + 15]) + " " for j in range(len(v) - 14)] if lang == "en" else ["".join(v)[j : j + 30] for j in range(len("".join(v)) - 29)]
            if any(p in (n if lang == "en" else s) for p in parts):
                want.add((k, i))
    assert {(r.doc_id, r.item_id) for r in leak.eval_leaks(table(spark, SMALL, "documents"), table(spark, SMALL, "eval_items")).collect()} == want


def test_reordered_coverage(spark):
    it = leak.Items([(1, PASSAGE)])
    w = PASSAGE.split()
    pieces = " ".join([*w[14:], "stop", *w[7:14], "stop", *w[:7]])
    got = it.tiles(*leak.letters([leak.plain(pieces)]))
    assert got[0][4] > 0.95 and got[0][2] < 15
    d = spark.createDataFrame([(1, pieces), (2, " ".join(w[:7])), (3, None)], "doc_id long, text string")
    i = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")
    for kw in ({}, {"max_broadcast_chars": -1}):
        assert leak.eval_leaks(d, i, decode=False, **kw).count() == 0
        assert [(r.doc_id, r.item_id) for r in leak.eval_leaks(d, i, decode=False, min_coverage=0.8, **kw).collect()] == [(1, 7)]
        assert {r.doc_id for r in leak.eval_leaks(d, i, decode=False, min_coverage=0.2, **kw).collect()} == {1, 2}


def brute_tiles(a, b, least):
    """Greedy string tiling by comparing all places again for every tile."""
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for p in range(len(a)):
            for d in range(len(b)):
                n = 0
                while p + n < len(a) and d + n < len(b) and a[p + n] == b[d + n] and not used_a[p + n] and not used_b[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, d)
        n, p, d = best
        if n < least:
            return out
        out.append(best)
        used_a[p : p + n], used_b[d : d + n] = [True] * n, [True] * n


def test_tiling_is_greedy():
    rnd = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randint(3, 30))) for _ in range(2))
        runs = []
        for p in range(len(a)):
            for d in range(len(b)):
                if a[p] == b[d] and not (p and d and a[p - 1] == b[d - 1]):
                    n = 0
                    while p + n < len(a) and d + n < len(b) and a[p + n] == b[d + n]:
                        n += 1
                    runs.append((n, p, d))
        assert leak.tile(runs, 3) == brute_tiles(a, b, 3)


def test_winnow_and_short_words(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abc") for _ in range(n)) for n in (0, 3, 16, 17, 20, 45, 300)]
    cp, off = leak.letters(texts)
    for size, span in ((16, 1), (16, 15), (5, 4), (15, 7)):
        h, own = leak.seed_hashes(cp, off, size)
        want = set()
        for r in range(len(texts)):
            x = h[own == r].view(np.int64).view(np.uint64)
            want |= {(r, int(x[i : i + span].min())) for i in range(max(1, len(x) - span + 1)) if len(x)}
        row, got = leak.winnow(cp, off, span, size)
        assert {(int(a), int(b) % 2**64) for a, b in zip(row, got)} == want and len(row) == len(want)
    # fifteen words of one letter are shorter than a seed
    d = spark.createDataFrame([(1, "x a b c d e f g h i j k l m n o y")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o"), (2, "p q r s t u v w x y z a b c d")], "item_id long, text string")
    for kw in ({}, {"max_broadcast_chars": -1}):
        assert [(r.doc_id, r.item_id, r.words) for r in leak.eval_leaks(d, i, decode=False, **kw).collect()] == [(1, 1, 15)]


def test_mail_parts():
    h, p = mail.parse('From a\nsubject: =?UTF-8?B?5rC0?=\nContent-Type: multipart/alternative; boundary=q\n\n--q\n\nplain\n--q\nContent-Type: text/html\n\n<html><p>r&amp;ich</p><blockquote>old</blockquote></html>\n--q--\ntrailer')
    assert mail.decode_words(h["subject"]) == "水" and [x.ctype for x in p] == ["text/plain", "text/html"]
    assert mail.html_text(p[1].text, keep_quotes=False).strip() == "r&ich"
    body = "Hi,\n\nMine one.\nMine two.\n\n-- \nName\ntel 1\n\nOn Mon, X wrote:\n> quoted\n> more\n\nAfter the quote.\n\n________\nlist footer\n"
    assert mail.own_paragraphs(body) == ["Hi,", "Mine one. Mine two.", "After the quote."]
    assert mail.parse(None) == ({}, []) and mail.all_text("garbage") and mail.parse("Content-Transfer-Encoding: base64\n\n%%%")[1][0].text == ""


def test_mail_whole_parts():
    deep = "Content-Type: text/plain\n\nat the bottom"
    for k in range(40):
        deep = f'Content-Type: multipart/mixed; boundary="b{k}"\n\n--b{k}\n{deep}\n--b{k}--\n'
    assert "at the bottom" in mail.all_text("Subject: x\n" + deep)
    late = "Content-Type: text/plain\n\n" + "<!-- " + "x" * 500 + " --> <!DOCTYPE html>\n<html><p>pas<b>sa</b>ge</p></html>"
    assert "passage" in mail.all_text(late)
    assert "ends here" in mail.all_text("Content-Type: application/octet-stream\n\n\x01\x02" + "y" * 300 + " ends here")
    assert "said <html>" in mail.all_text("Content-Type: text/plain\n\nhe said <html> " + "z" * 9)


def test_consensus(spark):
    rows = [(1, "law", 1), (1, "sport", 2), (1, "none", 3), *((2, "law", k) for k in range(1, 5)), (2, "sport", 5), (2, "sport", 5), (3, "none", 1), (4, None, 1), (None, "law", 1)]
    df = spark.createDataFrame(rows, "doc_id long, subject string, annotator int")
    assert {r.doc_id: set(r.subjects) for r in topics._consensus(df).collect()} == {1: {"law", "sport"}, 2: {"law"}, 3: set()}


def test_classes_of_questions(spark):
    q = spark.createDataFrame([("d", i, i, x) for i, x in enumerate(["a long text to compare", "a long text to compare", "a long text to compares", "else"])], "doc_id string, q_ord int, question_id long, label string")
    b = spark.createDataFrame([], "doc_id string, q_ord int, block_id long, block_ord int, block_type string, content string")
    assert {tuple(r) for r in neardup.question_classes(q, b).collect()} == {(0, 0, 2, 1), (1, 0, 2, 1), (2, 2, 1, 1), (3, 3, 1, 0)}


def mix_input(spark):
    rows = [(i, f"word {i} " * (1 + i % 7), "List-Serv " if i % 2 else "list_serv") for i in range(400)] + [(1000 + i, "other text here", "small") for i in range(10)] + [(2000, None, "small"), (2001, "x", None), (2002, "x", "unknown"), (1, "again", "list_serv")]
    t = [("list_serv", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, None), (None, 0.3, 1), ("zero", 0.0, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_tokens", F.lit(1)), spark.createDataFrame(t, "source string, target_share double, max_repeats int")


def test_mix(spark):
    docs, goal = mix_input(spark)
    m = mixing.mix(docs, goal).collect()
    assert len({r.doc_id for r in m}) == len(m)
    total = sum(r.n_tokens for r in m if r.source == "list_serv")
    assert {r.uses for r in m if r.source == "small"} == {3} and all(r.uses == 1 for r in m if r.source == "list_serv")
    s = {r.source: r for r in mixing.mix_shares(docs, goal).collect()}
    assert set(s) == {"list_serv", "small", "absent"} and s["absent"].mix_tokens == 0 and not s["absent"].is_met and s["list_serv"].mix_tokens == total
    assert mixing.mix(docs.limit(0), goal).count() == 0 and mixing.mix(docs, goal.limit(0)).count() == 0


def test_mix_ignores_partitioning(spark):
    docs, goal = mix_input(spark)
    again = docs.withColumn("text", F.concat("text", F.lit(" and more"))).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "small").otherwise(F.col("source")))
    key = lambda df, **kw: sorted((r.doc_id, r.source, r.n_tokens, r.uses) for r in mixing.mix(df, goal, budget=700, **kw).collect())
    want = key(docs.unionByName(again))
    for n in (1, 3, 7):
        assert key(again.unionByName(docs).repartition(n)) == want


def test_mix_repeats_without_rows(spark):
    docs = spark.createDataFrame([(i, "one two three", "a" if i < 3 else "b") for i in range(40)], "doc_id long, text string, source string")
    goal = spark.createDataFrame([("a", 0.5, 100_000_000), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs, goal).collect()
    each, budget = m[0].n_tokens, 40 * m[0].n_tokens
    assert sum(r.n_tokens * r.uses for r in m) == budget and sum(r.uses for r in m if r.source == "a") in range(18, 23) and {r.n_tokens for r in m} == {each}
    s = {r.source: r for r in mixing.mix_shares(docs, goal).collect()}
    assert all(abs(r.actual_share - 0.5) < 0.06 for r in s.values())
    # more budget than the sources have: everything, as often as allowed
    some = goal.withColumn("max_repeats", F.lit(2))
    assert {(r.uses) for r in mixing.mix(docs, some, budget=10**9).collect()} == {2}


def test_mix_is_the_fair_order(spark, monkeypatch):
    docs, goal = mix_input(spark)
    goal = goal.filter("source = 'small' OR source = 'list_serv'")
    d = mixing.count_tokens(docs.drop("n_tokens").filter("text != 'again'").select("doc_id", mixing.source_key("source").alias("source"), "text"), "text", ["doc_id", "source"])
    rows = d.filter("n_tokens > 0").withColumn("h", F.xxhash64("doc_id", F.lit(0))).collect()
    first = docs.filter("text != 'again' OR text IS NULL")
    uses = []
    for name, w, k in (("list_serv", 0.5, 1), ("small", 0.4, 3)):
        mine = sorted((r.h, r.doc_id, r.n_tokens) for r in rows if r.source == name)
        up, size = 0, sum(x[2] for x in mine)
        for _, i, n in mine:
            up += n
            uses += [((up + r * size) / w, name, i, r, n) for r in range(k)]
    for ranges in (100_000, 7):
        monkeypatch.setattr(mixing, "RANGE_ROWS", ranges)
        for budget in (0, 1, 60, 61, 500, 10_000):
            want: dict = {}
            left = budget
            for _, _, i, _, n in sorted(uses):
                if n > left:
                    break
                left -= n
                want[i] = want.get(i, 0) + 1
            assert {r.doc_id: r.uses for r in mixing.mix(first, goal, budget=budget).collect()} == want


def test_topics_held_out(spark):
    docs, labels, areas, items = (table(spark, LARGE, n) for n in ("documents", "subject_labels", "subject_areas", "eval_items"))
    train, test = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0), labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    extra = docs.withColumns({"subject": F.lit("x"), "level": F.lit(1), "label": F.lit(2)})
    got: dict = {}
    for r in topics.document_subjects(extra, train, areas, items).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    tp = fp = fn = 0
    for r in test.groupBy("doc_id").agg(F.collect_set("subject").alias("s")).collect():
        s, g = set(r.s) - {"none"}, got.get(r.doc_id, set())
        tp, fp = tp + len(s & g), fp + len(g - s)
        fn += len(s - g)
    assert tp >= 100 and tp / (tp + fp) >= 0.9 and tp / (tp + fn) >= 0.85


def test_topics_odd_inputs(spark):
    docs, labels, areas, items = (table(spark, SMALL, n) for n in ("documents", "subject_labels", "subject_areas", "eval_items"))
    odd = docs.limit(20).unionByName(docs.limit(2).withColumns({c: F.lit(None).cast(docs.schema[c].dataType) for c in docs.columns}))
    odd = odd.unionByName(docs.limit(1).withColumns({"text": F.lit(""), "doc_id": F.lit(-1).cast("long")}))
    assert topics.document_subjects(odd, labels, areas, items).filter("doc_id IS NULL OR doc_id = -1").count() == 0
    assert topics.document_subjects(docs, labels.limit(0), areas).count() == 0
    assert topics.document_subjects(docs.limit(0), labels, areas, items).count() == 0
    assert topics.document_subjects(docs, labels, areas.limit(0), items).count() == 0




def shuffled(spark, run):
    """Bytes that a run shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(x.shuffleWriteBytes() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


def test_groups_dont_copy_records(spark):
    rnd = random.Random(8)
    rows = [(i, "".join(rnd.choice("abcdefghijklmnop") for _ in range(120))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, text string")
    few, many = (shuffled(spark, lambda g=g: neardup.similar_pairs(df, "id", "text", group=g)[0].collect()) for g in (25_000_000, 12_000))
    assert many < 1.5 * few


def test_copies_arent_shuffled_as_pairs(spark):
    base = "a text of which there are many copies in this bank"
    b = spark.createDataFrame([], "doc_id string, q_ord int, block_id long, block_ord int, block_type string, content string")
    sizes = []
    for n in (100, 800):
        q = spark.createDataFrame([("d", i, i, base + "!" * (i % 2)) for i in range(n)], "doc_id string, q_ord int, question_id long, label string")
        pairs = neardup.similar_questions(q, b)
        sizes.append(shuffled(spark, lambda p=pairs, n=n: p.write.format("noop").mode("overwrite").save()))
        assert pairs.count() == n * (n - 1) // 2
    assert sizes[1] < 16 * sizes[0] + 30_000


def test_ids_with_several_texts(spark):
    base = ["first text that is long enough to compare", "second one, which differs from all the others"]
    q = spark.createDataFrame([("d", 0, 1, base[0]), ("d", 1, 1, base[1]), ("d", 2, 2, base[0] + "s"), ("d", 3, 2, base[1] + "s"), ("d", 4, 5, "x" + base[0]), ("d", 5, 5, base[0] + "x")], "doc_id string, q_ord int, question_id long, label string")
    b = spark.createDataFrame([], "doc_id string, q_ord int, block_id long, block_ord int, block_type string, content string")
    assert sorted(tuple(r) for r in neardup.similar_questions(q, b).collect()) == [(1, 2), (1, 5), (2, 5)]
