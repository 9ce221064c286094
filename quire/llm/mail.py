"""Raw mail messages -> decoded parts, and the sender's own paragraphs. Pure functions for use inside Arrow batches.

Handles mbox separators, CRLF, folded headers in any case, encoded words, multipart bodies with or without closing
boundary, nested messages, base64 and quoted-printable with damage, HTML. Never raises: what can't be decoded is empty.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
from typing import NamedTuple

_HEADER = re.compile(r"^([!-9;-~]+):[ \t]*(.*(?:\n[ \t].*)*)", re.M)
_BOUNDARY = re.compile(r"boundary\s*=\s*(?:\"([^\"]*)\"|([^\s;]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)
_WORD = re.compile(r"=\?([\w-]+)\?([bq])\?([^?]*)\?=(?:\s+(?==\?))?", re.I)
_DROP = re.compile(r"<!--.*?-->|<(style|script|head|title)\b.*?</\1\s*>", re.I | re.S)
_QUOTE_TAG = re.compile(r"<blockquote\b", re.I)
_BREAK = re.compile(r"<br\b[^>]*>|</?(?:tr|li|dt|dd)\b[^>]*>", re.I)
_BLOCK = re.compile(r"</?(?:p|div|h[1-6]|ul|ol|table|blockquote|pre|section|article|body|html|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_SPACE = re.compile(r"[ \t\r\n\f\xa0]+")


class Part(NamedTuple):
    ctype: str
    attached: bool
    text: str


def _charset(raw: bytes, name: str) -> str:
    for c in (name or "utf-8", "utf-8", "gb18030"):
        try:
            return raw.decode(c)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("latin-1")


def unbase64(text: str) -> bytes:
    clean = re.sub(r"[^A-Za-z0-9+/]", "", text)
    if len(clean) % 4 == 1:
        clean = clean[:-1]
    try:
        return base64.b64decode(clean + "=" * (-len(clean) % 4))
    except (binascii.Error, ValueError):
        return b""


def _decode(body: str, how: str, charset: str) -> str:
    how = how.strip().lower()
    if how == "base64":
        return _charset(unbase64(body), charset)
    if how == "quoted-printable":
        return _charset(binascii.a2b_qp(body.encode("utf-8", "replace")), charset)
    return body


def decode_words(value: str) -> str:
    """Encoded words of a header in plain text."""
    if "=?" not in value:
        return value

    def one(m: re.Match) -> str:
        raw = unbase64(m[3]) if m[2] in "bB" else binascii.a2b_qp(m[3].replace("_", " ").encode("utf-8", "replace"))
        return _charset(raw, m[1])

    return _WORD.sub(one, value)


def html_text(source: str, keep_quotes: bool = True) -> str:
    """Text of an HTML body: blocks become paragraphs, inline tags vanish without a blank."""
    s = _DROP.sub("", source)
    if not keep_quotes:
        s = _QUOTE_TAG.split(s)[0]
    s = _SPACE.sub(" ", s)
    s = _BLOCK.sub("\n\n", _BREAK.sub("\n", s))
    return html.unescape(_TAG.sub("", s))


def headers_of(raw: str) -> tuple[dict[str, str], str]:
    """(headers by lower-case name, body). The first of repeated headers counts."""
    if raw.startswith("From "):
        raw = raw.partition("\n")[2]
    head, _, body = raw.partition("\n\n")
    if ":" not in head.split("\n", 1)[0]:
        return {}, raw
    h: dict[str, str] = {}
    for m in _HEADER.finditer(head):
        h.setdefault(m[1].lower(), m[2].replace("\n", " ").strip())
    return h, body


def _walk(h: dict[str, str], body: str) -> list[Part]:
    """All leaf parts in order, however deep they are nested."""
    out: list[Part] = []
    waiting = [(h, body)]
    while waiting:
        h, body = waiting.pop()
        ctype = h.get("content-type", "text/plain")
        kind = ctype.split(";")[0].strip().lower()
        disposition = h.get("content-disposition", "").lower()
        attached = disposition.startswith("attachment") or "name=" in ctype.lower() and not disposition.startswith("inline")
        if kind.startswith("multipart/"):
            m = _BOUNDARY.search(ctype)
            mark = m and (m[1] or m[2])
            if mark:
                chunks = re.split(rf"(?:^|\n)--{re.escape(mark)}(--)?[ \t]*(?=\n|$)", body)
                if len(chunks) > 1:
                    # preamble, then (closing or None, chunk) ...
                    inner = []
                    for closing, chunk in zip(chunks[1::2], chunks[2::2]):
                        if closing:
                            break
                        inner.append(headers_of_part(chunk))
                    waiting += reversed(inner)
                    continue
        text = _decode(body, h.get("content-transfer-encoding", ""), (m := _CHARSET.search(ctype)) and m[1] or "utf-8")
        if kind == "message/rfc822":
            waiting.append(headers_of(text.replace("\r\n", "\n").lstrip("\n")))
        else:
            out.append(Part(kind, attached, text.replace("\r\n", "\n")))
    return out


def headers_of_part(chunk: str) -> tuple[dict[str, str], str]:
    """Headers and body of a body part, which may have no headers at all."""
    chunk = chunk[1:] if chunk.startswith("\n") else chunk
    if chunk.startswith("\n"):
        return {}, chunk[1:]
    head, gap, body = chunk.partition("\n\n")
    if not _HEADER.match(head):
        return {}, chunk
    return {m[1].lower(): m[2].replace("\n", " ").strip() for m in _HEADER.finditer(head)}, body


def parse(raw: str | None) -> tuple[dict[str, str], list[Part]]:
    if not raw:
        return {}, []
    if "\r" in raw:
        raw = raw.replace("\r\n", "\n").replace("\r", "\n")
    h, body = headers_of(raw)
    return h, _walk(h, body)


#: a document that begins as HTML, whatever it is said to be
_HTML = re.compile(r"(?:\s|<!--.*?-->|<\?[^>]*>|<!doctype\b[^>]*>)*<html\b", re.I | re.S)


def all_text(raw: str | None) -> str:
    """Everything a message says: subject and all decoded parts, mark-up removed, quote marks left in.

    Parts of every type count whole; what isn't text decodes to characters that match nothing.
    """
    h, parts = parse(raw)
    said = [decode_words(h.get("subject", ""))]
    for p in parts:
        said.append(html_text(p.text) if p.ctype == "text/html" or _HTML.match(p.text) else p.text)
    return "\n\n".join(said)


# --- the sender's own text -------------------------------------------------------------------------------------------

_HAN = re.compile("[㐀-鿿]")
_WIDE = frozenset("，。；：、（）“”！？")
_QUOTED = re.compile(r"^[ \t]*[>|]")
_ATTRIBUTION = re.compile(r"^(?:.{0,160}(?:\bwrote|写道|escribió|schrieb\b.{0,80}|a écrit)\s*[:：]|.{0,160}\bschrieb .{1,80}:)\s*$")
_ORIGINAL = re.compile(r"^[-_ ]{2,}\s*(?:original message|forwarded message|ursprüngliche nachricht|mensaje original|mensaje reenviado|原始邮件|转发邮件).*$", re.I)
_FIELD = re.compile(r"^(?:from|sent|to|cc|subject|date|von|gesendet|an|betreff|de|enviado|para|asunto|fecha|发件人|发送时间|收件人|主题|抄送|日期)\s*[:：]", re.I)
_RULE = re.compile(r"^[_=*-]{8,}\s*$")
_SENTENCE = re.compile(r"(?<=[.!?])[\"”’)]*\s+(?=\S)|(?<=[。！？])")


def own_text(parts: list[Part]) -> list[str]:
    """The sender's paragraphs in the first plain part that isn't attached, or in the first HTML one if that says far more."""
    plain = next((own_paragraphs(p.text) for p in parts if p.ctype == "text/plain" and not p.attached), [])
    rich = next((own_paragraphs(html_text(p.text, keep_quotes=False)) for p in parts if p.ctype == "text/html" and not p.attached), [])
    return rich if sum(map(len, rich)) > 1.5 * sum(map(len, plain)) else plain


def own_paragraphs(body: str) -> list[str]:
    """Paragraphs that the sender wrote: no quoted lines and their attributions, signature, list footer."""
    out: list[str] = []
    para: list[str] = []
    lines = body.split("\n")
    quoted = [bool(_QUOTED.match(x)) for x in lines]
    any_after = [False] * (len(lines) + 1)
    for i in range(len(lines) - 1, -1, -1):
        any_after[i] = any_after[i + 1] or quoted[i]
    signature = forwarded = False

    def flush() -> None:
        if para:
            text = para[0]
            for line in para[1:]:  # ideographs are wrapped without a blank
                text += line if _HAN.match(text[-1:]) or _HAN.match(line) or text[-1:] in _WIDE else " " + line
            out.append(text)
            para.clear()

    for i, line in enumerate(lines):
        bare = line.strip()
        if line.rstrip("\r") in ("-- ", "--") or bare == "--":
            flush()
            signature = True
        elif not bare:
            flush()
            signature = False
            forwarded = False
        elif signature:
            continue
        elif quoted[i]:
            flush()
            forwarded = False
        elif _ORIGINAL.match(bare):
            flush()
            if not any_after[i]:
                return out  # everything below was pasted without marks
            forwarded = True
        elif _RULE.match(bare):
            flush()
            if not any(quoted[i:]):
                return out
            signature = True  # a footer block above a quotation
        elif forwarded and _FIELD.match(bare):
            continue
        elif _ATTRIBUTION.match(bare):
            flush()
        else:
            para.append(bare)
    flush()
    return out


def sentences(paragraph: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(paragraph)) if s]
