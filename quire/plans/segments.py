"""Queries that segment exams into questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import classify as C
from quire.functions import rx
from quire.operators import segment as S
from quire.plans import sqlbits as B
from quire.plans import texts as X
from quire.session import table as t


def lines(s: SparkSession, d: str) -> DataFrame:
    return S.exam_lines(t(s, d, "blocks"), t(s, d, "questions"))


def markdown_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines with title blocks as ``## `` headings."""
    return lines(s, d).withColumn("line", F.when(F.col("text_level") == 1, F.concat(F.lit("## "), "line")).otherwise(F.col("line")))


def seg_lenient(s: SparkSession, d: str) -> DataFrame:
    return S.segment_lenient(lines(s, d)).withColumn("seg", F.col("seg").cast("bigint"))


def seg_lenient_images(s: SparkSession, d: str) -> DataFrame:
    return S.attach_page_images(S.segment_lenient(lines(s, d)), t(s, d, "page_images")).select("doc_id", F.col("seg").cast("bigint").alias("seg"), "source_page", "figure_path", F.length("content_md").cast("bigint").alias("n_chars"))


def seg_markdown(s: SparkSession, d: str) -> DataFrame:
    return S.segment_markdown(markdown_lines(s, d)).select("doc_id", F.col("seg").cast("bigint").alias("seg"), "q_index", "section", "stem", F.size("options").alias("n_options"), "q_type")


def _labels(s: SparkSession, d: str) -> DataFrame:
    b = S.distinct_blocks(t(s, d, "blocks")).filter("block_type = 'text' AND content IS NOT NULL AND q_ord IS NOT NULL")
    first = b.groupBy("doc_id", "q_ord").agg(F.min(F.struct("block_ord", "block_id")).alias("m"))
    label = t(s, d, "questions").groupBy("doc_id", "q_ord").agg(F.min("label").alias("label"))
    return label.join(first, ["doc_id", "q_ord"]).select(F.col("m.block_id").alias("block_id"), "label")


def seg_blocks(s: SparkSession, d: str) -> DataFrame:
    return S.segment_blocks(t(s, d, "blocks"), _labels(s, d)).select("block_id", F.col("seg").cast("bigint").alias("seg"), "q_index", "section")


def seg_block_questions(s: SparkSession, d: str) -> DataFrame:
    r = S.block_questions(S.segment_blocks(t(s, d, "blocks"), _labels(s, d)))
    return r.select("doc_id", F.col("seg").cast("bigint").alias("seg"), "q_index", "section", F.size("options").cast("bigint").alias("n_options"), "q_type", "n_images")


def topic_bridge(s: SparkSession, d: str) -> DataFrame:
    """Questions by the topic they are attached to, through the bridge."""
    q = S.distinct_questions(t(s, d, "questions"))
    topics, bridge = S.attach_topics(q, "section_title")
    return bridge.join(topics, "topic_id").join(q.select("question_id", "q_index"), "question_id").select("title", "n_questions", "question_id", "q_index", "priority")


def ingest_summary(s: SparkSession, d: str) -> DataFrame:
    """Counts of taking the text of all exams into an empty bank."""
    pages = lines(s, d).groupBy("doc_id", "page_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "block_id", "line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return S.ingest(pages, s.createDataFrame([], "content_md string"))[1]


def qnum_lines(s: SparkSession, d: str) -> DataFrame:
    c = F.col("line")
    n = lines(s, d).select("block_id", "line_no", C.top_qnum(c).alias("top"), C.digit_top(c).alias("digit"), C.sub_qnum(c).alias("sub"), C.union_qnum(c).alias("any_form"), C.is_instruction(c).alias("instruction"))
    return n.filter("top IS NOT NULL OR sub IS NOT NULL OR any_form IS NOT NULL OR instruction")


def qnum_stream(s: SparkSession, d: str) -> DataFrame:
    """Top-level numbers of a document in order, without instructions and sub-questions."""
    c = F.col("line")
    return lines(s, d).filter(~C.is_instruction(c) & C.sub_qnum(c).isNull()).withColumn("qnum", C.top_qnum(c)).filter("qnum IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("qnum").alias("total"), F.count_distinct("qnum").alias("different"))


_LENIENT = (
    f"WITH {B.LINES}, n AS (SELECT *, {B.digit_top('line')} AS dn, {B.circled_top('line')} AS cn FROM lines),"
    " seen AS (SELECT *, max(CASE WHEN dn IS NOT NULL THEN 1 ELSE 0 END) OVER w AS seen FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY block_ord, block_id, line_no ROWS UNBOUNDED PRECEDING)),"
    " num AS (SELECT *, coalesce(dn, CASE WHEN seen = 0 THEN cn END) AS num FROM seen),"
    " seg AS (SELECT *, sum(CASE WHEN num IS NOT NULL THEN 1 ELSE 0 END) OVER w AS seg FROM num WINDOW w AS (PARTITION BY doc_id ORDER BY block_ord, block_id, line_no ROWS UNBOUNDED PRECEDING)),"
    f" g AS (SELECT doc_id, seg, arg_min(num, (block_ord, block_id, line_no)) AS num, arg_min(page_idx, (block_ord, block_id, line_no)) AS source_page, {B.strip(f'''coalesce(string_agg(line, chr(10) ORDER BY block_ord, block_id, line_no) FILTER (WHERE {B.strip('line')} <> ''), '')''')} AS content_md FROM seg WHERE seg > 0 GROUP BY doc_id, seg),"
    " r AS (SELECT doc_id, seg::BIGINT AS seg, CASE WHEN num < 10 THEN '0' || num ELSE num::VARCHAR END AS source_qnum, source_page, content_md FROM g WHERE content_md <> '')"
)
_UNION = "|".join([f"{rx.OPEN}({rx.D}{{1,3}}){rx.CLOSE}", "([①-⑳])", *B.PLAIN_ALTS])


def _union_sql(x: str) -> str:
    p = f"^{rx.S}*(?:{_UNION})"
    rest = f"substr({x}, length(regexp_extract({x}, {B.q(p)})) + 1)"
    v = f"coalesce({B.number(x, p, 1)}, CASE WHEN {B.ext(x, p, 2)} <> '' THEN unicode({B.ext(x, p, 2)}) - 9311 END, {B.number(x, p, 3)}, {B.number(x, p, 4)}, {B.number(x, p, 5)})"
    return f"CASE WHEN {B.has(x, p)} AND NOT {B.has(rest, f'^{rx.D}')} AND {v} BETWEEN 1 AND 50 THEN {v} END"


_INSTR = f"({B.has(B.strip('line'), rx.any_of(rx.INSTRUCTION_HINTS))} AND length({B.strip('line')}) < 80)"
_TOP = f"coalesce({B.circled_top('line')}, {B.digit_top('line')})"
_SEC = f"CASE WHEN {B.has('line', f'^##{rx.S}*[一二三四五六七八九十]+(?:{rx.DOT}|{rx.S})')} THEN {B.strip('substr(line, 3)')} END"
_OPENER = f"^({rx.D}{{1,3}})(?:{rx.DOT}|{rx.S})"
_COUNT = lambda x: B.count(B.sub(x, "\\$[^$]*\\$", "\n"), "[ABCD]\\.")
_LATE = "^(.*?)([0-9０-９]+)\\.([^\\x00-\\x7f].*)$"
_AFTER = f"^((?s:.*?))[（(]{rx.S}*[）)]{rx.S}*([ABCD](?:[.．、]|{rx.S})[^\\n]*)((?s:.*))$"
_PIECE = f"len(list_filter(string_split({B.sub(B.ext('stem0', _AFTER, 2), f'([ABCD](?:[.．、]|{rx.S}))', '\x01\\1')}, '\x01'), lambda x: {B.has(B.strip('x'), f'^[ABCD](?:[.．、]|{rx.S})')}))::INTEGER"
_MARKDOWN = (
    f"WITH {B.LINES}, c AS (SELECT doc_id, block_ord, block_id, line_no, {B.clean_block("CASE WHEN text_level = 1 THEN '## ' || line ELSE line END")} AS line FROM lines),"
    f" n AS (SELECT *, {_SEC} AS sec, {B.number('line', _OPENER, 1)} AS k FROM c WHERE line <> '' AND NOT starts_with(line, '<!--') AND NOT {B.has('line', '^P[0-9]+[LR]$')}),"
    f" m0 AS (SELECT *, CASE WHEN sec IS NULL AND k BETWEEN 1 AND 50 THEN k END AS num, CASE WHEN {B.has('line', rx.OPTION_START)} THEN {B.number('line', _LATE, 2)} END AS lt FROM n),"
    " m1 AS (SELECT *, CASE WHEN num IS NULL AND lt BETWEEN 1 AND 50 AND coalesce(max(CASE WHEN num IS NOT NULL THEN 1 END) OVER (PARTITION BY doc_id ORDER BY block_ord, block_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN lt END AS late FROM m0),"
    f" m AS (SELECT doc_id, block_ord, block_id, line_no, 0 AS part, sec, num, CASE WHEN late IS NULL THEN line ELSE {B.strip(B.ext('line', _LATE, 1))} END AS line FROM m1 UNION ALL SELECT doc_id, block_ord, block_id, line_no, 1, NULL, late, {B.ext('line', _LATE, 3)} FROM m1 WHERE late IS NOT NULL),"
    " w AS (SELECT *, last_value(sec IGNORE NULLS) OVER w AS section, sum(CASE WHEN num IS NOT NULL THEN 1 ELSE 0 END) OVER w AS seg FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY block_ord, block_id, line_no, part ROWS UNBOUNDED PRECEDING)),"
    f" o AS (SELECT *, num IS NULL AND {B.has('line', rx.OPTION_START)} AS opt, CASE WHEN part = 1 THEN {B.strip('line')} WHEN num IS NOT NULL THEN {B.strip(B.sub('line', _OPENER, '', ''))} ELSE line END AS body FROM w WHERE seg > 0 AND sec IS NULL),"
    f" g AS (SELECT doc_id, seg::BIGINT AS seg, max(num) AS q_index, {B.strip("coalesce(string_agg(body, chr(10) ORDER BY block_ord, block_id, line_no, part) FILTER (WHERE NOT opt), '')")} AS stem0,"
    f" coalesce(sum(CASE WHEN {_COUNT('body')} >= 2 THEN {B.count(B.sub('body', '\\$[^$]*\\$', ''), f'[ABCD]{rx.DOT}')} ELSE 1 END) FILTER (WHERE opt), 0)::INTEGER AS n0, arg_min(coalesce(section, ''), (block_ord, block_id, line_no, part)) AS section1 FROM o GROUP BY doc_id, seg),"
    f" h AS (SELECT *, CASE WHEN n0 = 0 AND {B.has('stem0', _AFTER)} THEN {_PIECE} ELSE n0 END AS n_options, CASE WHEN n0 = 0 AND {B.has('stem0', _AFTER)} THEN {B.strip(f"{B.rstrip(B.ext('stem0', _AFTER, 1))} || {B.ext('stem0', _AFTER, 3)}")} ELSE stem0 END AS stem FROM g)"
    " SELECT doc_id, seg, q_index, nullif(section1, '') AS section, stem, n_options, CASE WHEN n_options > 0 THEN 'choice' WHEN contains(section1, '实验') THEN 'experiment' WHEN regexp_matches(section1, '计算|解答') THEN 'calculation' WHEN contains(section1, '填空') THEN 'fill_blank' ELSE 'unknown' END AS q_type FROM h"
)

_UNITS = f"(regexp_matches(rest, '^{rx.S}*(kg|m/|s/|J/s|J |N |W )') OR regexp_matches(rest, '^{rx.S}*[0-9]+[.]?[0-9]*{rx.S}*[A-Za-z]{rx.S}*/{rx.S}*[A-Za-z]'))"
_NOISY = "(contains(x, 'ZZZZ') OR contains(x, '<<') OR contains(x, '>>') OR contains(translate(x, '}', '{'), '{{') OR regexp_matches(x, '[?][?](\\s|$)'))"
_OPT = f"regexp_matches(x, '^[ABCD]([.．、]|{rx.S})')"
_SEG_BLOCKS = (
    "WITH b AS (SELECT DISTINCT block_id, doc_id, block_ord, q_ord, block_type, content, page_idx, text_level, col_side, bbox FROM blocks), tx AS (SELECT * FROM b WHERE block_type = 'text' AND content IS NOT NULL AND q_ord IS NOT NULL), fi AS (SELECT doc_id, q_ord, arg_min(block_id, (block_ord, block_id)) AS block_id FROM tx GROUP BY ALL),"
    " la AS (SELECT fi.block_id, l.label FROM fi JOIN (SELECT doc_id, q_ord, min(label) AS label FROM questions GROUP BY ALL) l USING (doc_id, q_ord)),"
    f" c AS (SELECT b.* EXCLUDE (content), {B.clean_block("coalesce(CASE WHEN label IS NOT NULL THEN concat_ws(' ', label, content) ELSE content END, '')")} AS x FROM b LEFT JOIN la USING (block_id)),"
    f" d AS (SELECT *, CASE WHEN len(bbox) = 4 THEN greatest(bbox[2], bbox[4]) END AS bottom, block_type = 'text' AND coalesce(text_level, 0) = 1 AS heading, {_OPT} AS opt, block_type = 'text' AND length(x) < 30 AND {_NOISY} AND NOT {_OPT} AS noise, {B.number('x', _OPENER, 1)} AS k, {B.sub('x', _OPENER, '', '')} AS rest FROM c),"
    f" e AS (SELECT *, CASE WHEN block_type = 'text' AND NOT heading AND NOT noise AND NOT opt AND k BETWEEN 1 AND 50 AND NOT {_UNITS} THEN k END AS num, block_type = 'text' AND NOT heading AND NOT noise AS plain FROM d),"
    " f AS (SELECT *, sum(CASE WHEN num IS NOT NULL THEN 1 ELSE 0 END) OVER w AS sg, last_value(CASE WHEN heading THEN x END IGNORE NULLS) OVER w AS section FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY block_ord, block_id ROWS UNBOUNDED PRECEDING)),"
    f" s AS (SELECT doc_id, sg, max(num) AS n, bool_or(plain AND NOT opt AND (contains(x, '如图') OR contains(x, '图像') OR contains(x, '示意图'))) AS figure, bool_or(plain AND (opt OR {_COUNT('x')} >= 2)) AS has_options,"
    " arg_max(struct_pack(v := CASE WHEN block_type = 'text' THEN bottom END), (block_ord, block_id)) FILTER (WHERE NOT heading AND NOT noise AND NOT (plain AND opt) AND block_type <> 'image') AS ends FROM f WHERE sg > 0 GROUP BY ALL),"
    " l AS (SELECT doc_id, max((block_ord, block_id)) AS last, max(sg) AS asked FROM f WHERE block_type <> 'image' GROUP BY ALL),"
    " h AS (SELECT f.*, CASE WHEN block_type = 'image' AND f.sg = 0 THEN CASE WHEN asked > 0 THEN 1 ELSE 0 END WHEN block_type = 'image' AND (block_ord, block_id) < last AND (coalesce(p.figure, false) OR (coalesce(p.has_options, false) AND coalesce(coalesce(bottom, 0) < p.ends.v + 50, false))) THEN f.sg - 1"
    " WHEN f.sg = 0 AND block_type = 'equation' AND asked > 0 THEN 1 ELSE f.sg END AS seg FROM f LEFT JOIN s p ON f.doc_id = p.doc_id AND f.sg = p.sg + 1 LEFT JOIN l ON f.doc_id = l.doc_id),"
    " z AS (SELECT h.*, s.n AS q_index FROM h LEFT JOIN s ON h.doc_id = s.doc_id AND h.seg = s.sg WHERE seg > 0 AND NOT noise AND NOT heading)"
)
_ZX = f"CASE WHEN num IS NOT NULL THEN {B.strip(B.sub('x', _OPENER, '', ''))} ELSE x END"
_BLOCK_QUESTIONS = (
    f"{_SEG_BLOCKS}, y AS (SELECT *, {_ZX} AS v, contains(coalesce(section, ''), '实验') AND opt AS lab FROM z),"
    f" c2 AS (SELECT *, CASE WHEN block_type <> 'text' OR lab THEN 0 WHEN {_COUNT('v')} >= 2 THEN {B.count(B.sub('v', '\\$[^$]*\\$', ''), '[ABCD][.．、]')} WHEN regexp_matches(v, '^[ABCD]([.．、]|{rx.S})') THEN 1 ELSE 0 END AS n FROM y),"
    " g AS (SELECT doc_id, seg::BIGINT AS seg, max(q_index) AS q_index, arg_min(coalesce(section, ''), (block_ord, block_id)) AS sec, sum(n)::BIGINT AS n_options, count(*) FILTER (WHERE block_type = 'image') AS n_images FROM c2 GROUP BY ALL)"
    " SELECT doc_id, seg, q_index, nullif(sec, '') AS section, n_options, CASE WHEN n_options > 0 THEN 'choice' WHEN contains(sec, '实验') THEN 'experiment' WHEN regexp_matches(sec, '计算|解答') THEN 'calculation' WHEN contains(sec, '填空') THEN 'fill_blank' ELSE 'unknown' END AS q_type, n_images FROM g"
)
_PAGES = (
    f"WITH RECURSIVE {B.LINES}, pl AS (SELECT doc_id, page_idx AS block_ord, page_idx::BIGINT AS block_id, page_idx, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY block_ord, block_id, line_no)::INTEGER AS line_no, line FROM lines)"
    + _LENIENT.removeprefix(f"WITH {B.LINES}").replace("FROM lines)", "FROM pl)")
)
_INGEST = (
    f"{_PAGES}, src AS (SELECT doc_id, seg, {X._tail_trim('content_md')} AS text FROM r), {X.reattached('src', 'doc_id, seg')}, dr AS (SELECT doc_id, {X.normalised('out')} AS content_md FROM re),"
    f" ks AS (SELECT count(*) AS drafts, count(DISTINCT {B.sub("lower(coalesce(content_md, ''))", f'{rx.S}+', '')}) AS inserted FROM dr), pg AS (SELECT doc_id, page_idx, bool_and({B.strip('line')} = '') AS gap FROM lines GROUP BY ALL),"
    " fs AS (SELECT doc_id, bool_or(gap) AS gap, doc_id IN (SELECT doc_id FROM dr) AS done FROM pg GROUP BY doc_id)"
    " SELECT drafts, inserted, drafts - inserted AS skipped, 0::BIGINT AS near_dup, (SELECT count(*) FROM fs WHERE done) AS files_completed, (SELECT count(*) FROM fs WHERE done AND gap) AS files_partial, (SELECT count(*) FROM fs) AS files_total, (SELECT count(*) FROM fs WHERE NOT done) AS files_failed FROM ks"
)
QUERIES = {f.__name__: f for f in (seg_lenient, seg_lenient_images, seg_markdown, seg_blocks, seg_block_questions, topic_bridge, ingest_summary, qnum_lines, qnum_stream)}
ORACLE = {
    "seg_lenient": f"{_LENIENT} SELECT *, {B.question_type('content_md', "'fill_blank'")} AS q_type FROM r",
    "seg_lenient_images": f"{_LENIENT}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source_page ORDER BY seg) AS k FROM r),"
    " i AS (SELECT doc_id, page_idx AS source_page, path, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY y0, path) AS k FROM (SELECT DISTINCT doc_id, page_idx, path, y0 FROM page_images WHERE path IS NOT NULL))"
    f" SELECT doc_id, seg, source_page, path AS figure_path, (length(content_md) + CASE WHEN path IS NULL THEN 0 ELSE length({B.ext('path', '([^/]*)$', 1)}) + 14 END)::BIGINT AS n_chars FROM k LEFT JOIN i USING (doc_id, source_page, k)",
    "seg_markdown": _MARKDOWN,
    "seg_blocks": f"{_SEG_BLOCKS} SELECT block_id, seg::BIGINT AS seg, q_index, section FROM z",
    "seg_block_questions": _BLOCK_QUESTIONS,
    "ingest_summary": _INGEST,
    "topic_bridge": f"WITH {B.QUESTIONS} SELECT section_title AS title, count(*) OVER (PARTITION BY section_title) AS n_questions, question_id, q_index, 100 AS priority FROM qs WHERE section_title IS NOT NULL",
    "qnum_lines": f"WITH {B.LINES}, n AS (SELECT block_id, line_no, {_TOP} AS top, {B.digit_top('line')} AS digit, {B.sub_qnum('line')} AS sub, {_union_sql('line')} AS any_form, {_INSTR} AS instruction FROM lines) SELECT * FROM n WHERE top IS NOT NULL OR sub IS NOT NULL OR any_form IS NOT NULL OR instruction",
    "qnum_stream": f"WITH {B.LINES}, n AS (SELECT doc_id, {_TOP} AS qnum FROM lines WHERE NOT {_INSTR} AND {B.sub_qnum('line')} IS NULL) SELECT doc_id, count(*) AS n, sum(qnum) AS total, count(DISTINCT qnum) AS different FROM n WHERE qnum IS NOT NULL GROUP BY doc_id",
}
