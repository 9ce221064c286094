"""Choice text -> its options, with the rules of reaction schemes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import circled_macro, strip_tags

HEAD = "^\\s*[A-D][.．、]"
ARROWS = "(?:→|⇌|=|>|<|:)$"


def parse_choices(c: Column) -> Column:
    """array<struct<letter, text, bare>>: option lines and other lines in order; text after an option belongs to it.

    A line is cut before labels at its start or after a blank, unless the part before ends like a reaction; it is cut
    only if the labels follow each other in the alphabet (and it starts with one, or the first is A). Of equal letters
    the last one counts. ``bare``: the option has no text, so it is a picture.
    """
    none = F.array().cast("array<string>")
    is_opt = lambda x: x.rlike(HEAD)
    letter = lambda x: F.regexp_extract(x, "^\\s*([A-D])", 1)

    def cut(line: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(line, "(?:(?<=^)|(?<=\\s))(?=[A-D][.．、])", "\u0001"), "\u0001"), lambda x: x != "")
        join = lambda acc, p: (F.size(acc) > 0) & is_opt(p) & F.rtrim(F.element_at(acc, -1)).rlike(ARROWS)
        merged = F.aggregate(parts, none, lambda acc, p: F.when(join(acc, p), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), p)))).otherwise(F.concat(acc, F.array(p))))
        codes = F.transform(F.filter(merged, is_opt), lambda x: F.ascii(letter(x)))
        chain = F.forall(F.sequence(F.lit(1), F.greatest(F.size(codes) - 1, F.lit(1))), lambda i: (F.size(codes) < 2) | (F.get(codes, i) - F.get(codes, i - 1) == 1))
        starts = is_opt(line) | (F.get(codes, F.lit(0)) == 65)
        return F.when((F.size(codes) > 0) & starts & chain, F.filter(F.transform(merged, F.trim), lambda x: x != "")).otherwise(F.array(line))

    text = circled_macro(strip_tags(c))
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    flat = F.flatten(F.transform(lines, cut))
    # the last of equal letters stays, in the place of the first
    last = lambda x: F.element_at(F.filter(flat, lambda y: is_opt(y) & (letter(y) == letter(x))), -1)
    place = lambda x, i: F.size(F.filter(F.slice(flat, 1, i), lambda y: is_opt(y) & (letter(y) == letter(x)))) == 0
    kept = F.filter(F.transform(flat, lambda x, i: F.when(~is_opt(x), x).when(place(x, i), last(x))), lambda x: x.isNotNull())
    start = F.array().cast("array<struct<letter:string,text:string>>")

    def fold(acc: Column, x: Column) -> Column:
        item = F.struct(F.when(is_opt(x), letter(x)).alias("letter"), F.when(is_opt(x), F.regexp_replace(x, HEAD, "")).otherwise(x).alias("text"))
        prev = F.element_at(acc, -1)
        longer = F.struct(prev["letter"].alias("letter"), F.concat(prev["text"], x).alias("text"))
        glue = (F.size(acc) > 0) & ~is_opt(x) & prev["letter"].isNotNull()
        return F.when(glue, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(item)))

    return F.transform(F.aggregate(kept, start, fold), lambda o: F.struct(o["letter"].alias("letter"), o["text"].alias("text"), (o["letter"].isNotNull() & (F.trim(o["text"]) == "")).alias("bare")))
