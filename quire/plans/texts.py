"""Queries of the scalar text functions and classifiers, over all blocks or all questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import classify as C
from quire.functions import options as P
from quire.functions import rx
from quire.functions import text as X
from quire.operators import segment as S
from quire.plans import sqlbits as B
from quire.session import table as t


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return S.distinct_blocks(t(s, d, "blocks")).filter("content IS NOT NULL").select("block_id", "block_type", "content")


def _each(f, out: str = "out"):  # noqa: ANN001, ANN202
    def query(s: SparkSession, d: str) -> DataFrame:
        return _blocks(s, d).select("block_id", f(F.col("content")).alias(out))

    return query


def question_md(s: SparkSession, d: str) -> DataFrame:
    """(question_id, question_type, content_md): label, text blocks in order and option lines of every question."""
    q = S.distinct_questions(t(s, d, "questions"))
    b = S.distinct_blocks(t(s, d, "blocks")).filter("block_type = 'text' AND q_ord IS NOT NULL AND content IS NOT NULL")
    b = b.groupBy("doc_id", "q_ord").agg(F.array_sort(F.collect_list(F.struct("block_ord", "block_id", "content"))).alias("bs"))
    body = F.transform(F.coalesce("bs", F.array().cast("array<struct<block_ord:int,block_id:bigint,content:string>>")), lambda x: x["content"])
    opts = F.filter(F.coalesce("options", F.array().cast("array<string>")), lambda x: x.isNotNull())
    parts = F.concat(F.array(F.coalesce("label", F.lit(""))), body, opts)
    return q.join(b, ["doc_id", "q_ord"], "left").select("question_id", "doc_id", "q_ord", "q_index", "source_page", "section_title", "is_multi_select", "question_type", "options", F.array_join(parts, "\n").alias("content_md"))


def type_ladder(s: SparkSession, d: str) -> DataFrame:
    c = F.col("content_md")
    return question_md(s, d).select("question_id", C.question_type(c, F.col("question_type")).alias("q_type"), C.is_experiment(c).alias("experiment"), C.has_calc_hint(c).alias("calc_hint"), P.are_real_options(F.col("options")).alias("real_options"))


def opt_count(s: SparkSession, d: str) -> DataFrame:
    c = F.col("content_md")
    return question_md(s, d).select("question_id", P.count_options(c).cast("bigint").alias("n_labels"), F.size(F.filter(F.split(c, "\n"), P.is_inline_options)).cast("bigint").alias("n_inline_lines"))


def opt_split(s: SparkSession, d: str) -> DataFrame:
    r = question_md(s, d).select("question_id", P.split_options(F.col("content_md")).alias("r"))
    return r.select("question_id", "r.stem", F.size("r.options").alias("n_options"), F.array_join("r.options", "\u0001").alias("options"))


def opt_inline(s: SparkSession, d: str) -> DataFrame:
    return question_md(s, d).select("question_id", P.split_inline_options(F.col("content_md")).alias("out"))


def prose_reattach(s: SparkSession, d: str) -> DataFrame:
    return question_md(s, d).select("question_id", S.reattach_prose(F.col("content_md")).alias("out"))


def normalise(s: SparkSession, d: str) -> DataFrame:
    return S.normalise(question_md(s, d).select("question_id", "content_md", F.col("question_type").alias("q_type")))


def tail_trim(s: SparkSession, d: str) -> DataFrame:
    return question_md(s, d).select("question_id", X.tail_trim(F.col("content_md")).alias("out"))


def option_prose(s: SparkSession, d: str) -> DataFrame:
    return S.exam_lines(t(s, d, "blocks"), t(s, d, "questions")).filter(C.is_option_prose(F.col("line"))).select("block_id", "line_no")


def answer_mode(s: SparkSession, d: str) -> DataFrame:
    return question_md(s, d).select("question_id", C.answer_mode(F.col("content_md")).alias("mode"))


def text_marks(s: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    r = _blocks(s, d).select("block_id", C.is_complex_equation(c).alias("complex_equation"), X.is_page_number(c).alias("page_number"), C.is_instruction(c).alias("instruction"), F.coalesce(c.rlike(rx.SECTION_LINE), F.lit(False)).alias("section_line"))
    return r.filter("complex_equation OR page_number OR instruction OR section_line")


def paths(s: SparkSession, d: str) -> DataFrame:
    """Content-addressed names and path parts of page images."""
    p = F.col("path")
    i = t(s, d, "page_images").filter("path IS NOT NULL").select("path").distinct()
    return i.select("path", X.basename(p).alias("base"), X.stem(p).alias("stem"), X.suffix(p).alias("ext"), X.content_name(p.cast("binary"), F.substring(X.suffix(p), 2, 10)).alias("name"))


KEEP_TABLES = "(<(?:pre|code|table)[\\s\\S]*?</(?:pre|code|table)>)"
_LATEX_KEEP = "(\\$\\$[\\s\\S]+?\\$\\$|\\$[^$\\n]+?\\$|<span class=\"katex[^\"]*\">[\\s\\S]*?</span>)"
_LATEX_CMD = f"(?i:\\\\(?:{rx.LATEX_COMMANDS})(?:\\{{[^{{}}]*\\}})?(?:\\{{[^{{}}]*\\}})?)"
_B = "WITH b AS (SELECT DISTINCT block_id, block_type, content FROM blocks WHERE content IS NOT NULL)"
_MD = (
    f"WITH {B.QUESTIONS}, bs AS (SELECT doc_id, q_ord, string_agg(content, chr(10) ORDER BY block_ord, block_id) AS body FROM (SELECT DISTINCT block_id, doc_id, block_ord, q_ord, content FROM blocks WHERE block_type = 'text' AND q_ord IS NOT NULL AND content IS NOT NULL) GROUP BY ALL),"
    " md AS (SELECT qs.*, coalesce(label, '') || coalesce(chr(10) || body, '') || coalesce(list_aggregate(list_transform(list_filter(options, lambda o: o IS NOT NULL), lambda o: chr(10) || o), 'string_agg', ''), '') AS content_md FROM qs LEFT JOIN bs USING (doc_id, q_ord))"
)


def _sql(expr: str) -> str:
    return f"{_B} SELECT block_id, {expr} AS out FROM b"


_GAP = "'\x01'"
# the rules of is_complex_equation on the pieces between dollars, said in lists
_PIECES = "string_split(content, '$')"
_CLOSED = f"(len({_PIECES}) - 1 - (len({_PIECES}) - 1) % 2)"
_FORMULAS = f"list_filter(range(0, {_CLOSED}), lambda i: i % 2 = 1)"
_MARKED = (
    f"list_aggregate(list_transform(range(0, {_CLOSED} + 1), lambda i: CASE WHEN i % 2 = 0 THEN ({_PIECES})[i + 1] WHEN starts_with(ltrim(({_PIECES})[i + 1]), '\\mathrm{{') AND strpos(rtrim(({_PIECES})[i + 1]), '}}') = length(rtrim(({_PIECES})[i + 1]))"
    f" THEN '$' || ({_PIECES})[i + 1] || '$' || {_GAP} ELSE '$' || ({_PIECES})[i + 1] || '$' END), 'string_agg', '')"
)
_FRAGS = f"string_split({_MARKED}, {_GAP})"
_REST = "string_split(content, '\\mathrm')[-1]"
_WORDS = "regexp_split_to_array(content, '\\s+')"
_COMPLEX = (
    f"(coalesce(list_sum(list_transform({_FORMULAS}, lambda i: length(({_PIECES})[i + 1]) + 2)), 0)::DOUBLE / greatest(length(content), 1) >= 0.6 AND ("
    + " OR ".join(f"contains(content, {B.q(a)})" for a in C.ARROWS)
    + f" OR (contains(content, '\\mathrm') AND ({_REST} = '' OR (starts_with({_REST}, '{{') AND NOT contains({_REST}, '}}'))))"
    f" OR len(list_filter(list_slice({_FRAGS}, 2, len({_FRAGS}) - 1), lambda x: length(x) < 30)) > 0"
    f" OR (len({_FORMULAS}) >= 3 AND len(list_filter(range(2, {_CLOSED}, 2), lambda i: length(({_PIECES})[i + 1]) >= 10)) = 0)"
    f" OR len(list_filter(range(1, greatest(len({_WORDS}) - 2, 1)), lambda i: regexp_matches(({_WORDS})[i], '[\\][A-Za-z]+$') AND regexp_matches(({_WORDS})[i + 1], '^[{{][A-Z][}}]$') AND ({_WORDS})[i + 2] = '_' AND starts_with(({_WORDS})[i + 3], '{{'))) > 0))"
)
_LBL = f"(^|[^\\p{{L}}\\p{{N}}_}}])([ABCD]{rx.DOT}){rx.S}"
_TAILP = f"^([\\s\\S]*?(?:求|计算){rx.S}*[:：])([\\s\\S]*)$"
_PROSE = (
    f"length({B.strip('line')}) >= 6 AND NOT {B.has(B.strip('line'), rx.OPTION_LINE)} AND NOT {B.has(B.strip('line'), f'^{rx.S}*{rx.D}{{1,2}}{rx.DOT}{rx.S}')} AND NOT {B.has(B.strip('line'), f'^{rx.S}*[一二三四五六七八九十]+[、．]{rx.S}')}"
    f" AND NOT contains(line, '如图') AND {B.strip('line')} NOT IN ({', '.join(map(B.q, rx.FIGURE_LABELS))})"
    f" AND {B.has(B.strip('line'), f'\\$[^$]*\\$|[，。；：,;:]|{rx.D}+{rx.S}*(?:{rx.UNITS})|{rx.any_of(rx.CONTINUATION)}')}"
)
_INSTR = f"({B.has(B.strip('content'), rx.any_of(rx.INSTRUCTION_HINTS))} AND length({B.strip('content')}) < 80)"
_SUBN = f"len(list_distinct(regexp_extract_all({B.sub('content_md', '<[^>]+>', '')}, {B.q(f'[(（]{rx.S}*([1-9]){rx.S}*[)）]')}, 1)))"
# twice, as neighbouring labels share the blank between them
_INLINE_CUT = B.sub(B.sub("x", _LBL, "\\1\x01\\2 "), _LBL, "\\1\x01\\2 ")


def _inline(x: str) -> str:
    bare = B.sub(x, "\\$[^$]*\\$", "")
    twice = B.sub(bare, f"({rx.S})", "\\1\\1")
    first = B.ext(bare, f"^([\\s\\S]*?)(?:^|[^\\p{{L}}\\p{{N}}_}}])[ABCD]{rx.DOT}{rx.S}", 1)
    begins = B.has(bare, f"^[ABCD]{rx.DOT}{rx.S}")
    return f"({B.count(twice, _LBL)} >= 3 AND ({begins} OR length({first}) + 1 <= 30))"


_P = f"string_split({_INLINE_CUT}, {_GAP})"
_INLINE_LINE = (
    f"CASE WHEN {_inline('x')} AND len({_P}) >= 3 THEN CASE WHEN {B.rstrip(f'{_P}[1]')} <> '' THEN {B.rstrip(f'{_P}[1]')} || chr(10) ELSE '' END"
    f" || coalesce(list_aggregate(list_transform(list_filter(({_P})[2:], lambda o: {B.strip('substr(o, 3)')} <> ''), lambda o: substr(o, 1, 2) || ' ' || {B.strip('substr(o, 3)')}), 'string_agg', chr(10)), '') ELSE x END"
)

def _tail_trim(x: str) -> str:
    return f"CASE WHEN contains({x}, '求') AND {B.has(x, _TAILP)} AND NOT {B.has(B.ext(x, _TAILP, 2), rx.SUBQ)} AND length({B.strip(B.ext(x, _TAILP, 2))}) < 6 THEN {B.rstrip(B.ext(x, _TAILP, 1))} ELSE {x} END"


def reattached(source: str, cols: str = "id") -> str:
    """CTEs that end in ``re`` (cols, out): the option prose of ``source`` (cols, text) joined to its options, a line at a time."""
    head, prose = B.has("line", rx.OPTION_LINE), f"(NOT {B.has('line', rx.OPTION_LINE)} AND {_PROSE})"
    letter = f"greatest(coalesce(list_position(['A', 'B', 'C', 'D', 'E', 'F'], upper(left({B.strip('line')}, 1))), 0) - 1, 0)"
    upper = "(len(wait) > 0 AND pos >= 0 AND pos = len(done) - 1)"
    joined = f"list_append(list_slice(done, 1, pos), {B.strip(f"{B.rstrip('done[pos + 1]')} || list_aggregate(wait, 'string_agg', '')")})"
    first = f"CASE WHEN len(wait) > 0 THEN {B.strip(f"{B.rstrip('line')} || wait[1]")} ELSE line END"
    dealt = f"list_concat(list_append(done, {first}), list_transform(range(2, len(wait) + 1), lambda j: ['A', 'B', 'C', 'D', 'E', 'F'][least({letter} + j - 1, 5) + 1] || '. ' || {B.strip('wait[j]')}))"
    return (
        f"steps AS (SELECT {cols}, string_split(text, chr(10)) AS ls, 0 AS i, []::VARCHAR[] AS done, []::VARCHAR[] AS wait, -1 AS pos FROM {source}"
        f" UNION ALL SELECT {cols}, ls, i + 1, CASE WHEN {head} THEN CASE WHEN {upper} THEN list_append({joined}, line) ELSE {dealt} END WHEN {prose} THEN done ELSE list_append(done, line) END,"
        f" CASE WHEN {head} THEN []::VARCHAR[] WHEN {prose} THEN list_append(wait, {B.strip('line')}) ELSE wait END, CASE WHEN {head} THEN len(done) WHEN {prose} THEN pos ELSE -1 END"
        f" FROM (SELECT *, ls[i + 1] AS line FROM steps WHERE i < len(ls))),"
        f" re AS (SELECT {cols}, list_aggregate(list_concat(done, wait), 'string_agg', chr(10)) AS out FROM steps WHERE i = len(ls))"
    )


def normalised(x: str) -> str:
    """What follows the reattaching: one option a line, no runs of zeros."""
    lines = f"list_aggregate(list_transform(string_split({x}, chr(10)), lambda x: {_INLINE_LINE}), 'string_agg', chr(10))"
    return B.strip(B.sub(B.sub(lines, f"{rx.S}0{{8,}}{rx.S}*[A-Z]?{rx.D}*{rx.S}*", " "), " {2,}", " "))


_MARKED_OPTIONS = f"regexp_replace(translate(replace({B.sub('content_md', f'([$][^$]*[$])|([ABCD](?:[.．、]|{rx.S}))', '\x01\\1\x02\\2')}, '\x01\x02', '\x04'), '\x01\x02', ''), '\x04([ABCD][.．、])', '\x05\\1', 'g')"
_OPTION_PARTS = f"string_split(replace({_MARKED_OPTIONS}, '\x04', ''), '\x05')"
ocr_punct, clean_block, ocr_noise, strip_tags, escape_html = _each(X.ocr_punct), _each(X.clean_block), _each(X.ocr_noise), _each(X.strip_tags), _each(X.escape_html)
ws_collapse, latex_wrap, strip_sections = _each(X.collapse_blanks), _each(X.wrap_latex), _each(X.strip_sections)
NAMED = {"ocr_punct": ocr_punct, "clean_block": clean_block, "ocr_noise": ocr_noise, "strip_tags": strip_tags, "escape_html": escape_html, "ws_collapse": ws_collapse, "latex_wrap": latex_wrap, "strip_sections": strip_sections}
QUERIES = NAMED | {f.__name__: f for f in (type_ladder, opt_count, opt_split, opt_inline, prose_reattach, normalise, tail_trim, option_prose, answer_mode, text_marks, paths)}
ORACLE = {
    "ocr_punct": _sql(B.ocr_punct("content")),
    "clean_block": _sql(B.clean_block("content")),
    "ocr_noise": _sql(B.strip(B.sub(B.sub("content", f"{rx.S}0{{8,}}{rx.S}*[A-Z]?{rx.D}*{rx.S}*", " "), " {2,}", " "))),
    "strip_tags": _sql(B.sub("content", "<[^>]+>", "")),
    "escape_html": _sql("replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"),
    "ws_collapse": _sql(f"replace({B.sub(B.sub(B.sub('content', KEEP_TABLES + '|[ \\t]+(\\n)', '\\1\\2'), KEEP_TABLES + '|[ \\t]{2,}', '\\1\x01'), '(</(?:pre|code|table)>)\x01', '\\1')}, {_GAP}, ' ')"),
    "latex_wrap": _sql(f"translate(replace({B.sub('content', f'{_LATEX_KEEP}|({_LATEX_CMD})', '\\1\x01\\2\x02')}, '\x01\x02', ''), '\x01\x02', '$$')"),
    "strip_sections": _sql(f"coalesce(list_aggregate(list_filter(string_split(content, chr(10)), lambda x: NOT {B.has('x', rx.SECTION_LINE)}), 'string_agg', chr(10)), '')"),
    "type_ladder": f"{_MD} SELECT question_id, {B.question_type('content_md', 'question_type')} AS q_type, {B.experiment('content_md')} AS experiment, {B.has('content_md', rx.any_of(rx.CALC_HINTS))} AS calc_hint, coalesce({B.real_options('''list_transform(options, lambda z: coalesce(z, ''))''')}, false) AS real_options FROM md",
    "opt_count": f"{_MD} SELECT question_id, {B.count(B.sub('content_md', '\\$[^$]*\\$', '\n'), '[ABCD]\\.')} AS n_labels, len(list_filter(string_split(content_md, chr(10)), lambda x: {_inline('x')})) AS n_inline_lines FROM md",
    "opt_split": f"{_MD}, o AS (SELECT question_id, {_OPTION_PARTS} AS p FROM md) SELECT question_id, {B.rstrip('p[1]')} AS stem, (len(p) - 1)::INTEGER AS n_options, coalesce(list_aggregate(list_transform(list_slice(p, 2, len(p)), lambda x: {B.strip('x')}), 'string_agg', '\x01'), '') AS options FROM o",
    "prose_reattach": f"{_MD.replace('WITH ', 'WITH RECURSIVE ', 1)}, src AS (SELECT question_id AS id, content_md AS text FROM md), {reattached('src')} SELECT id AS question_id, out FROM re",
    "normalise": f"{_MD.replace('WITH ', 'WITH RECURSIVE ', 1)}, src AS (SELECT question_id AS id, question_type, {_tail_trim('content_md')} AS text FROM md), {reattached('src', 'id, question_type')}, no AS (SELECT id, question_type, {normalised('out')} AS content_md FROM re) SELECT id AS question_id, content_md, {B.question_type('content_md', 'question_type')} AS q_type FROM no",
    "opt_inline": f"{_MD} SELECT question_id, list_aggregate(list_transform(string_split(content_md, chr(10)), lambda x: {_INLINE_LINE}), 'string_agg', chr(10)) AS out FROM md",
    "tail_trim": f"{_MD} SELECT question_id, {_tail_trim('content_md')} AS out FROM md",
    "option_prose": f"WITH {B.LINES} SELECT block_id, line_no FROM lines WHERE {_PROSE}",
    "answer_mode": f"{_MD} SELECT question_id, CASE WHEN {B.has(B.sub('content_md', '<[^>]+>', ''), f'回答{rx.S}*下列{rx.S}*(?:问题|各题)')} OR {_SUBN} >= 2 THEN 'free_response' ELSE 'choice' END AS mode FROM md",
    "text_marks": f"{_B}, m AS (SELECT block_id, {_COMPLEX} AS complex_equation, {B.has('content', '^[\\s\\-—]*(?:[0-9]+\\s*(?:[/／]|of)\\s*[0-9]+|第\\s*[0-9]+\\s*页|Page\\s*[0-9]+|[0-9]+)[\\s\\-—]*$')} AS page_number, {_INSTR} AS instruction, {B.has('content', rx.SECTION_LINE)} AS section_line FROM b) SELECT * FROM m WHERE complex_equation OR page_number OR instruction OR section_line",
    "paths": "WITH i AS (SELECT DISTINCT path FROM page_images WHERE path IS NOT NULL) SELECT path, regexp_extract(path, '([^/\\\\]*)$', 1) AS base, regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem, lower(regexp_extract(regexp_extract(path, '([^/\\\\]*)$', 1), '.(\\.[^.]*)$', 1)) AS ext, 'mineru_' || substr(md5(path), 1, 12) || lower(regexp_extract(path, '.(\\.[^.]*)$', 1)) AS name FROM i",
}
