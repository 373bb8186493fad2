"""Passages of texts by an estimate of tokens, previews, highlights and the parts of identifiers; for Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.functions import fixed


def _weights() -> np.ndarray:
    """Sixteenths of a token by a character's first byte."""
    u = fixed.UNIT
    w = np.full(256, u["symbol"])
    w[[9, 10, 11, 12, 13, 32]] = u["space"]
    w[48:58] = u["digit"]
    w[65:91] = w[97:123] = u["letter"]
    w[0x80:0xE0], w[0xE0:0xF0], w[0xF0:] = u["two"], u["three"], u["four"]
    return w


WEIGHT = _weights()
SENTENCE = re.compile(rb"[.!?;](?=[ \n])")


def _seam(raw: bytes, low: int, high: int) -> int:
    """The last good cut in (low, high]: behind a blank line, a line, a sentence, a word; else high."""
    for mark in (b"\n\n", b"\n"):
        at = raw.rfind(mark, max(0, low - len(mark) + 1), high)
        if at >= 0:
            return at + len(mark)
    ends = [m.end() for m in SENTENCE.finditer(raw, low, min(high + 1, len(raw))) if m.end() <= high]
    if ends:
        return ends[-1]
    at = raw.rfind(b" ", low, high)
    return at + 1 if at >= 0 else high


def passages(text: str) -> list[tuple[int, int]]:
    """(offset, length) in bytes of UTF-8: passages that stay within the budget of estimated tokens, cut where the text does, overlapping."""
    raw = text.encode()
    if not raw:
        return []
    b = np.frombuffer(raw, np.uint8)
    starts = np.flatnonzero((b & 0xC0) != 0x80)
    ends = np.r_[starts[1:], len(raw)]
    sums = np.cumsum(WEIGHT[b[starts]])
    budget = fixed.CHUNK_TOKENS * fixed.UNITS_A_TOKEN

    def reach(at: int) -> int:
        first = np.searchsorted(starts, at)
        i = np.searchsorted(sums, (sums[first - 1] if first else 0) + budget)
        return int(ends[i]) if i < len(ends) else len(raw)

    whole = lambda at: int(starts[np.searchsorted(starts, at, "right") - 1]) if at < len(raw) else at
    out, start = [], 0
    while True:
        limit = reach(start)
        if limit >= len(raw):
            return [*out, (start, len(raw) - start)]
        cut = whole(_seam(raw, start + (limit - start) * 6 // 10, limit))
        if cut <= start + fixed.CHUNK_LEAST:
            cut = whole(limit)
        out.append((start, cut - start))
        following = whole(cut - min(fixed.CHUNK_OVERLAP, (cut - start) // 4))
        start = following if following > start else cut


def snippet(text: str, offset: int, length: int, terms: list[str], size: int = 240, trim: int = 40) -> str:
    """``size`` bytes of a passage around the first of the terms, from a word's start, with dots where it goes on."""
    raw = text.encode()
    low, high = (offset, min(len(raw), offset + length)) if 0 <= offset < len(raw) else (0, len(raw))
    region = raw[low:high].decode("utf-8", "replace")
    hits = [low + len(region[:i].encode()) for i in (region.lower().find(t.lower()) for t in terms) if i >= 0]
    hit = min(hits, default=low)
    start = max(low, hit - size // 2)
    end = min(high, start + size)
    while start > low and raw[start] & 0xC0 == 0x80:
        start -= 1
    while end < high and raw[end] & 0xC0 == 0x80:
        end += 1
    if start > low:
        gap = re.compile(rb"[ \n]").search(raw, start, min(end, start + trim))
        start = gap.end() if gap else start
    shown = raw[start:end].decode("utf-8", "replace").replace("\n", " ")
    return ("… " if start > low else "") + shown + (" …" if end < high else "")


def highlight(text: str, query: str) -> str:
    """Every hit of the query's terms marked, the earlier one where they overlap; the text is escaped."""
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    lower = text.lower()
    terms = [t.lower() for t in re.split(r'[\s"]+', query) if len(t) >= 2]
    spans = sorted((m.span() for t in terms for m in re.finditer(re.escape(t), lower)), key=lambda s: s[0]) if len(lower) == len(text) else []
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [escape(text[at:a]), "<mark>", escape(text[a:b]), "</mark>"]
            at = b
    return "".join([*out, escape(text[at:])])


WORD = re.compile(r"[A-Za-z0-9_]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|_+")


def identifier_parts(text: str) -> list[str]:
    """The parts of identifiers with underscores or humps, lowered, of two letters or more; other words have none."""
    out = []
    for word in WORD.findall(text):
        parts = [p for p in HUMP.split(word) if p]
        if "_" in word or len(parts) > 1:
            out += [p.lower() for p in parts if len(p) >= 2]
    return out


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, seq, boff, blen) of the passages of every text; null and empty texts have none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, t in zip(ids, b.column(1).to_pylist()):
                out += [(i, s, o, n) for s, (o, n) in enumerate(passages(t or ""))]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=[id_col, "seq", "boff", "blen"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, seq bigint, boff bigint, blen bigint")
