"""Scalar text functions, Column -> Column, all inside whole-stage code generation. Null in, null out; empty stays empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import rx


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(c, f"^{rx.S}+|{rx.S}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{rx.S}+$", "")


def ocr_punct(c: Column) -> Column:
    """Misread question and exclamation marks in full width."""
    c = F.regexp_replace(c, f"\\?\\?(?={rx.HAN})", "？")
    c = F.regexp_replace(c, f"\\?!(?={rx.HAN})", "！")
    c = F.regexp_replace(c, "\\?\\?(?!\\?)", "？")
    return F.regexp_replace(c, "!(?![?!])", "！")


def clean_block(c: Column) -> Column:
    """ocr_punct, runs of three or more blanks to two, stripped."""
    return strip(F.regexp_replace(ocr_punct(c), " {3,}", "  "))


def ocr_noise(c: Column) -> Column:
    """Runs of eight or more zeros with their tail become a blank; blanks are squeezed."""
    c = F.regexp_replace(c, f"{rx.S}0{{8,}}{rx.S}*[A-Z]?{rx.D}*{rx.S}*", " ")
    return strip(F.regexp_replace(c, " {2,}", " "))


def tail_trim(c: Column) -> Column:
    """Cut what follows the first 求: or 计算: if it is shorter than six characters and no sub-question."""
    pattern = f"^([\\s\\S]*?(?:求|计算){rx.S}*[:：])([\\s\\S]*)$"
    tail = F.regexp_extract(c, pattern, 2)
    cut = c.contains("求") & c.rlike(pattern) & ~tail.rlike(rx.SUBQ) & (F.length(strip(tail)) < 6)
    return F.when(cut, rstrip(F.regexp_extract(c, pattern, 1))).otherwise(c)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def collapse_blanks(c: Column) -> Column:
    """Runs of blanks and tabs to one, none before a line end; pre, code and table elements are left as they are."""
    keep = "(<(?:pre|code|table)[\\s\\S]*?</(?:pre|code|table)>)"
    c = F.regexp_replace(c, f"{keep}|[ \\t]+(?=\\n)", "$1")
    return _squeeze(c, keep)


def _squeeze(c: Column, keep: str) -> Column:
    # the protected element is replaced by itself, a run of blanks by one blank
    marked = F.regexp_replace(c, f"{keep}|[ \\t]{{2,}}", "$1\u0001")
    marked = F.regexp_replace(marked, "(</(?:pre|code|table)>)\u0001", "$1")
    return F.replace(marked, F.lit("\u0001"), F.lit(" "))


def wrap_latex(c: Column) -> Column:
    """Bare LaTeX commands in dollars; existing formulas and rendered spans are skipped by an earlier alternative."""
    keep = "(\\$\\$[\\s\\S]+?\\$\\$|\\$[^$\\n]+?\\$|<span class=\"katex[^\"]*\">[\\s\\S]*?</span>)"
    cmd = f"(?i:\\\\(?:{rx.LATEX_COMMANDS})(?:\\{{[^{{}}]*\\}})?(?:\\{{[^{{}}]*\\}})?)"
    c = F.regexp_replace(c, f"{keep}|({cmd})", "$1\u0001$2\u0002")
    c = F.regexp_replace(c, "\u0001\u0002", "")
    return F.translate(c, "\u0001\u0002", "$$")


def circled_macro(c: Column) -> Column:
    return F.regexp_replace(c, "\\$\\\\textcircled\\{(\\d+)\\}\\$", "<span class=\"circled\">$1</span>")


def ascii_digits(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def pad_qnum(n: Column) -> Column:
    """Two digits at least, so that text order is number order."""
    s = n.cast("string")
    return F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)


def content_name(data: Column, ext: Column) -> Column:
    """Content-addressed file name: first 12 digits of the MD5."""
    return F.concat(F.lit("mineru_"), F.substring(F.md5(data), 1, 12), F.lit("."), ext)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), "(?<=.)\\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), "(?<=.)(\\.[^.]*)$", 1))


def semver(c: Column) -> Column:
    """(major, minor, patch), pre-release ignored; null if it isn't three numbers."""
    p = f"^{rx.S}*v?(\\d+)\\.(\\d+)\\.(\\d+)(?:[-+].*)?{rx.S}*$"
    return F.when(c.rlike(p), F.struct(*[F.regexp_extract(c, p, i).cast("int").alias(f"v{i}") for i in (1, 2, 3)]))


def strip_sections(c: Column) -> Column:
    """Without the lines that are section headings."""
    lines = F.split(c, "\n")
    kept = F.filter(lines, lambda x: ~x.rlike(rx.SECTION_LINE))
    return F.when(F.size(kept) < F.size(lines), F.array_join(kept, "\n")).otherwise(c)


def is_page_number(c: Column) -> Column:
    """A line that is only a page number, in one of the plain styles."""
    return c.rlike(r"^[\s\-—]*(?:\d+\s*(?:[/／]|of)\s*\d+|第\s*\d+\s*页|Page\s*\d+|\d+)[\s\-—]*$")


def math_italics(c: Column, enabled: bool = False) -> Column:
    """Mathematical italic letters as plain ones. Off by default, when text comes back as it is."""
    if not enabled:
        return c
    italic = "".join(chr(x) for base in (0x1D434, 0x1D44E) for x in range(base, base + 26))
    plain = "".join(chr(x) for base in (ord("A"), ord("a")) for x in range(base, base + 26))
    return F.translate(c, italic, plain)
