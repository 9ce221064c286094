"""Pieces of DuckDB SQL that stand for the same patterns and views; RE2 has no look-around, so what follows a match is tested apart."""

from __future__ import annotations

from quire.functions import rx

q = lambda s: "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{rx.S}+|{rx.S}+$')}, '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'{rx.S}+$')}, '')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def ext(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def sub(x: str, pattern: str, repl: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, '{flags}')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def digits(x: str) -> str:
    return f"translate({x}, '０１２３４５６７８９', '0123456789')"


def number(x: str, pattern: str, group: int) -> str:
    return f"try_cast({digits(ext(x, pattern, group))} AS INTEGER)"


def lines_of(x: str) -> str:
    return f"string_split_regex({x}, {q('\r\n|[\n\r\\x0b\\x0c\x1c-\x1e\x85  ]')})"


GUARDED = f"^(?:{rx.D}{{1,3}}{rx.DOT}|{rx.D}{{1,3}}{rx.S}?[a-zA-Z])"
PLAIN_ALTS = (f"第{rx.S}*({rx.D}{{1,3}}){rx.S}*题", f"(?:[TQ]|题){rx.S}*({rx.D}{{1,3}}){rx.DOT}", f"({rx.D}{{1,3}}){rx.DOT}")


def guarded(x: str, head: str, value: str) -> str:
    """value if the line begins with head and what follows isn't a decimal or a quantity."""
    rest = f"substr({x}, length(regexp_extract({x}, {q(f'^{rx.S}*(?:{head})')})) + 1)"
    return f"CASE WHEN {has(x, f'^{rx.S}*(?:{head})')} AND NOT {has(rest, GUARDED)} THEN {value} END"


def digit_top(x: str) -> str:
    parts = [guarded(x, a, number(x, f"^{rx.S}*{a}", 1)) for a in PLAIN_ALTS]
    return "(SELECT CASE WHEN v BETWEEN 1 AND 50 THEN v END FROM (SELECT coalesce(" + ", ".join(parts) + ") AS v))"


def circled_top(x: str) -> str:
    return guarded(x, "[①-⑳]", f"unicode({ext(x, f'^{rx.S}*([①-⑳])', 1)}) - 9311")


def sub_qnum(x: str) -> str:
    head = f"^{rx.S}*{rx.OPEN}({rx.D}{{1,3}}){rx.CLOSE}"
    v = number(x, head, 1)
    return f"CASE WHEN {has(x, head)} AND NOT {has(x, head + rx.D)} AND {v} BETWEEN 1 AND 50 THEN {v} END"


def experiment(x: str) -> str:
    return f"({has(x, rx.any_of(rx.STRONG_EXPERIMENT))} OR ({has(x, rx.any_of(rx.WEAK_EXPERIMENT))} AND {has(x, rx.any_of(rx.OPERATION))}))"


def real_options(a: str) -> str:
    s = f"list_transform({a}, lambda o: {strip('o')})"
    letters = f"list_transform({s}, lambda o: unicode(o))"
    return (
        f"(len({a}) >= 3 AND len(list_filter({s}, lambda o: NOT (length(o) BETWEEN 2 AND 100 AND {has('o', rx.OPTION_START)}))) = 0"
        f" AND len(list_filter(range(2, len({a}) + 1), lambda i: list_extract({letters}, i) <= list_extract({letters}, i - 1))) = 0)"
    )


def question_type(text: str, current: str) -> str:
    t = strip(text)
    opts = f"list_filter({lines_of(t)}, lambda x: {has('x', rx.OPTION_LINE)})"
    bare = f"len(list_filter({lines_of(t)}, lambda x: {has(strip('x'), f'^{rx.OPEN}?[ABCD]{rx.CLOSE}?{rx.S}*{rx.DOT}?{rx.S}*$')}))"
    types = ", ".join(map(q, rx.TYPES))
    return (
        f"CASE WHEN coalesce({text}, '') = '' THEN coalesce(nullif({current}, ''), 'fill_blank')"
        f" WHEN {real_options(opts)} THEN 'choice' WHEN {has(t, f'{rx.OPEN}{rx.S}*{rx.CLOSE}')} AND {bare} >= 2 THEN 'choice'"
        f" WHEN {experiment(t)} THEN 'experiment' WHEN {has(t, rx.SCORE)} OR {has(t, rx.any_of(rx.CALC_HINTS))} OR {has(t, rx.SUBQ)} THEN 'calculation'"
        f" WHEN {current} IN ({types}) THEN {current} ELSE 'fill_blank' END"
    )


def clean_block(x: str) -> str:
    return strip(sub(ocr_punct(x), " {3,}", "  "))


def ocr_punct(x: str) -> str:
    x = sub(x, f"\\?\\?({rx.HAN})", "？\\1")
    x = sub(x, f"\\?!({rx.HAN})", "！\\1")
    x = sub(x, "(\\?*)\\?\\?", "\\1？")
    return sub(x, "!([^?!]|$)", "！\\1")


BLOCKS = "b AS (SELECT DISTINCT block_id, doc_id, block_ord, q_ord, block_type, content, page_idx, text_level, col_side FROM blocks)"
QUESTIONS = "qs AS (SELECT DISTINCT question_id, doc_id, q_ord, q_index, label, section_title, options, question_type, source_page, col_side, is_multi_select FROM questions)"
#: the view exam_lines, as CTEs
LINES = (
    f"{BLOCKS}, t AS (SELECT * FROM b WHERE block_type = 'text' AND content IS NOT NULL),"
    " first AS (SELECT doc_id, q_ord, arg_min(block_id, (block_ord, block_id)) AS block_id FROM t WHERE q_ord IS NOT NULL GROUP BY ALL),"
    " lab AS (SELECT f.block_id, l.label FROM first f JOIN (SELECT doc_id, q_ord, min(label) AS label FROM questions GROUP BY ALL) l USING (doc_id, q_ord)),"
    f" whole AS (SELECT t.*, {lines_of("coalesce(label || ' ', '') || content")} AS ls FROM t LEFT JOIN lab USING (block_id)),"
    " lines AS (SELECT doc_id, block_ord, block_id, page_idx, text_level, unnest(range(len(ls)))::INTEGER AS line_no, unnest(ls) AS line FROM whole)"
)
