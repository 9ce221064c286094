"""Answer options inside text: counting, splitting, checking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import rx
from quire.functions.text import rstrip, strip

FORMULA = "\\$[^$]*\\$"
#: an inline label: not after a letter, digit or closing brace, with a mark and a blank
LABEL = f"(?<![\\p{{L}}\\p{{N}}_}}])([ABCD]{rx.DOT}){rx.S}"


def count_options(c: Column) -> Column:
    """Labels ``A.`` outside formulas; the formula's place keeps both sides apart."""
    return F.regexp_count(F.regexp_replace(c, FORMULA, "\n"), F.lit("[ABCD]\\."))


def is_inline_options(c: Column) -> Column:
    """Three or more labels outside formulas, the first within 30 characters."""
    bare = F.regexp_replace(c, FORMULA, "")
    return (F.regexp_count(bare, F.lit(LABEL)) >= 3) & (F.length(F.regexp_extract(bare, f"^([\\s\\S]*?){LABEL}", 1)) <= 30)


def split_inline_options(c: Column) -> Column:
    """Options crowded on a line to one line each; lines that aren't such are untouched, empty options go."""

    def line(x: Column) -> Column:
        parts = F.split(F.regexp_replace(x, LABEL, "\u0001$1"), "\u0001")
        body = lambda p: strip(F.substring(p, 3, 1 << 20))
        opts = F.transform(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(body(p)) > 0), lambda p: F.concat(F.substring(p, 1, 2), F.lit(" "), body(p)))
        prefix = rstrip(parts[0])
        return F.when(is_inline_options(x) & (F.size(parts) >= 3), F.concat(F.when(prefix != "", F.concat(prefix, F.lit("\n"))).otherwise(""), F.array_join(opts, "\n"))).otherwise(x)

    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def are_real_options(options: Column) -> Column:
    """Three or more, each of 2 to 100 characters with a label, labels strictly rising. Null arrays are no options."""
    s = F.transform(options, lambda x: strip(F.coalesce(x, F.lit(""))))
    letters = F.transform(s, lambda x: F.ascii(x))
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(letters) - 1, F.lit(1))), lambda i: F.coalesce(F.get(letters, i) > F.get(letters, i - 1), F.lit(False)))
    good = F.forall(s, lambda x: (F.length(x).between(2, 100)) & x.rlike(rx.OPTION_START))
    return F.coalesce((F.size(options) >= 3) & good & rising, F.lit(False))


def split_options(c: Column, keep_tail: bool = True) -> Column:
    """struct(stem, options): cut before labels outside formulas; what precedes the first label is the stem.

    A piece between labels that has none belongs to the open option; ``keep_tail=False`` drops such pieces instead.
    """
    # pieces: formulas whole, other text cut before a label
    cut = F.regexp_replace(c, f"({FORMULA})|(?=[ABCD](?:{rx.DOT}|{rx.S}))", "\u0001$1\u0001")
    pieces = F.filter(F.split(cut, "\u0001"), lambda x: x != "")
    labelled = lambda x: strip(x).rlike(f"^[ABCD]{rx.DOT}")
    start = F.struct(F.lit("").alias("stem"), F.array().cast("array<string>").alias("opts"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        formula = x.rlike("^\\$[\\s\\S]*\\$$")
        new = ~formula & labelled(x)
        lost = ~formula & ~labelled(x) & F.lit(not keep_tail)
        closed = F.when(acc["open"].isNotNull() & (acc["open"] != ""), F.concat(acc["opts"], F.array(strip(acc["open"])))).otherwise(acc["opts"])
        stem = F.when(acc["open"].isNull() & ~new, F.concat(acc["stem"], x)).otherwise(acc["stem"])
        opts = F.when(new | (lost & acc["open"].isNotNull()), closed).otherwise(acc["opts"])
        open_ = F.when(new, x).when(acc["open"].isNull(), F.lit(None)).when(lost, F.lit("")).otherwise(F.concat(acc["open"], x))
        return F.struct(stem.alias("stem"), opts.alias("opts"), open_.alias("open"))

    def done(acc: Column) -> Column:
        opts = F.when(acc["open"].isNotNull() & (acc["open"] != ""), F.concat(acc["opts"], F.array(strip(acc["open"])))).otherwise(acc["opts"])
        return F.struct(rstrip(acc["stem"]).alias("stem"), F.filter(opts, lambda x: x.rlike(f"^[ABCD]{rx.DOT}")).alias("options"))

    return F.aggregate(pieces, start, step, done)
