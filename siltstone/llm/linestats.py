"""Statistics of the lines of many texts at once, with numpy over the code points of a whole batch.

A line is what stands between newlines; blank lines are passed over. A word is a run of letters, marks and digits with at
least one letter. Blanks, letters and the rest are as Unicode has them.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

LETTER, UPPER, DIGIT, BLANK, END, MINOR, SYMBOL, ODD = range(8)
ENDS, CLOSERS = ".!?…:;。！？", "\"'»”’)]"  # fixed values: marks that end a sentence or clause, and what may follow them
MINORS = ",'’-\"()«»“”„‘–—¿¡[]/&%€$£°"  # fixed values: marks that prose has inside sentences
SEPARATORS = ",;|\t"
PRIME = np.uint64(1099511628211)

TABLE = 0x20000  # code points classed ahead; the few beyond are classed as they come
_tables: list[np.ndarray] = []


def _class(c: str) -> int:
    k = unicodedata.category(c)
    if c.isspace() or k in ("Zs", "Zl", "Zp"):
        return BLANK
    if k in ("Lu", "Lt"):
        return UPPER
    if k[0] in "LM":
        return LETTER
    if k[0] == "N":
        return DIGIT
    if c in ENDS:
        return END
    return MINOR if c in MINORS else SYMBOL if k[0] in "PS" else ODD


def classed(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case) of each code point, by Unicode's categories."""
    if not _tables:
        kinds = np.fromiter((_class(chr(i)) for i in range(TABLE)), np.uint8, TABLE)
        _tables.extend([kinds, np.fromiter((ord(chr(i).lower()[0]) if kinds[i] <= UPPER else i for i in range(TABLE)), np.uint32, TABLE)])
    far = np.flatnonzero(code >= TABLE)
    near = np.where(code < TABLE, code, 0) if len(far) else code
    kind, lower = _tables[0][near], _tables[1][near]
    if len(far):
        kind[far] = [_class(chr(i)) for i in code[far]]
        lower[far] = code[far]
    return kind, lower


def word_hash(words: list[str]) -> np.ndarray:
    """The hash that hashes() gives these words, in lower case."""
    out = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for i, w in enumerate(words):
            h = np.uint64(0)
            for c in w.lower():
                h = h * PRIME + np.uint64(ord(c) + 1)
            out[i] = h
    return out


def hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 24) -> np.ndarray:
    """Polynomial hashes of code[start:end], of at most the first ``most`` letters and the length."""
    h = np.zeros(len(start), np.uint64)
    size = end - start
    with np.errstate(over="ignore"):
        for i in range(min(most, int(size.max(initial=0)))):
            live = np.flatnonzero(size > i) if i else slice(None)
            h[live] = h[live] * PRIME + code[start[live] + i].astype(np.uint64) + np.uint64(1)
    return h


@dataclass
class Lines:
    doc: np.ndarray  # index of the text
    chars: np.ndarray  # length without the blanks at its ends
    features: np.ndarray
    words: np.ndarray
    letters_in_words: np.ndarray
    common: np.ndarray
    symbols: np.ndarray
    filled: np.ndarray  # characters that are no blanks
    ends_well: np.ndarray
    word_line: np.ndarray  # of each word
    word_id: np.ndarray  # of each word: 1 + index of the common word, 0 for another


NAMES = [
    "log_length", "letters", "digits", "symbols", "odd", "ends", "minors", "upper", "blanks", "log_word", "common", "ends_well", "starts_letter", "starts_upper", "marked",
    "separators", "same_separators", "wide_gaps", "repeats", "switches", "seen", "same_start", "words", "long_word", "colon", "case_switch", "alone", "again", "pairs"]


def lines(texts: list[str], common: np.ndarray, pairs: np.ndarray | None = None) -> Lines:
    """Statistics of the lines of non-null texts. ``common`` are hashes of common words, sorted; ``pairs`` scores of
    adjacent words by their ids (1 + position in ``common``, 0 for others)."""
    code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind, lower = classed(code)
    breaks = np.flatnonzero(code == 10)
    starts = np.r_[0, breaks[:-1] + 1]
    sizes = np.array([len(t) for t in texts], np.int64)
    first_char = np.r_[0, np.cumsum(sizes + 1)[:-1]] if len(texts) else np.empty(0, np.int64)
    filled = kind != BLANK
    at = np.flatnonzero(filled)
    f0, f1 = np.searchsorted(at, starts), np.searchsorted(at, breaks)
    keep = f1 > f0
    starts, breaks, f0, f1 = starts[keep], breaks[keep], f0[keep], f1[keep]
    n, n_filled = len(starts), f1 - f0
    doc = np.searchsorted(first_char, starts, "right") - 1
    a, b = at[f0], at[f1 - 1] + 1  # the line without the blanks at its ends
    span = (b - a).astype(np.float64)
    line = np.zeros(len(code), np.int32)  # of each character; those outside all lines are never counted
    line[starts[1:]] = 1
    np.cumsum(line, out=line)
    table = np.bincount(line[at].astype(np.int64) * 8 + kind[at], minlength=n * 8)[: n * 8].reshape(n, 8).astype(np.float64)
    count = lambda mask: (lambda p: np.bincount(line[p], minlength=n)[:n])(np.flatnonzero(mask)).astype(np.float64)
    upper, digit = kind == UPPER, kind == DIGIT
    letter = (kind == LETTER) | upper
    letters = table[:, LETTER] + table[:, UPPER]
    # words: runs of letters and digits with a letter in them
    part = letter | digit
    edge = np.diff(np.r_[False, part, False].astype(np.int8))
    w0, w1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    c_letter = np.cumsum(letter, dtype=np.int32)
    real = c_letter[w1 - 1] - c_letter[w0] + letter[w0] > 0
    w0, w1 = w0[real], w1[real]
    h = hashes(lower, w0, w1)
    if len(common):
        spot = np.minimum(np.searchsorted(common, h), len(common) - 1)
        word_id = np.where(common[spot] == h, spot + 1, 0)
    else:
        word_id = np.zeros(len(h), np.int64)
    word_line = line[w0].astype(np.int64)
    words = np.bincount(word_line, minlength=n).astype(np.float64)
    in_words = np.bincount(word_line, (w1 - w0).astype(np.float64), minlength=n)
    commons = np.bincount(word_line, (word_id > 0).astype(np.float64), minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, word_line, (w1 - w0).astype(np.float64))
    low = np.uint64(40)
    key = np.sort((word_line.astype(np.uint64) << low) | (h & np.uint64((1 << 40) - 1)))
    fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
    distinct = np.bincount((key[fresh] >> low).astype(np.int64), minlength=n).astype(np.float64)
    # how a line ends and starts
    last = code[b - 1]
    closer = np.isin(last, [ord(x) for x in CLOSERS])
    before = np.where(closer & (b - 2 >= a), b - 2, b - 1)
    ends_well = np.isin(code[before], [ord(x) for x in ENDS])
    k0, k1 = kind[a], kind[np.minimum(a + 1, len(code) - 1)]
    k2 = kind[np.minimum(a + 2, len(code) - 1)]
    c1, c2 = code[np.minimum(a + 1, len(code) - 1)], code[np.minimum(a + 2, len(code) - 1)]
    short = np.isin(c1, [ord("."), ord(")")]) | ((k1 == DIGIT) & np.isin(c2, [ord("."), ord(")")]))
    marked = ((k0 >= END) & (k1 == BLANK)) | (((k0 == DIGIT) | (k0 == LETTER)) & short & (span > 3)) | ((code[a] == ord("[")) & (c2 == ord("]")))
    by_separator = [count(code == ord(x)) for x in SEPARATORS]
    most = np.max(by_separator, axis=0)
    same_doc = np.r_[False, doc[1:] == doc[:-1]] if n else np.empty(0, bool)
    prev = lambda x, fill=0: np.r_[[fill], x[:-1]] if n else x
    follow = lambda x, fill=0: np.r_[x[1:], [fill]] if n else x
    next_same = follow(same_doc, False).astype(bool)
    same_separators = (most > 0) & ((same_doc & (prev(most) == most)) | (next_same & (follow(most) == most)))
    gap = np.flatnonzero(at[1:] - at[:-1] > 3)  # three blanks or more inside a line
    gap = gap[line[at[gap]] == line[at[gap + 1]]]
    wide_gaps = np.bincount(line[at[gap]], minlength=n)[:n] > 0
    repeats = count(np.r_[False, code[1:] == code[:-1]])
    group = np.array([0, 0, 1, 3, 2, 2, 2, 2], np.uint8)[kind]  # letters, digits, other marks, blanks
    inside = filled[1:] & filled[:-1]
    switches = count(np.r_[False, inside & (group[1:] != group[:-1])])
    case_switch = count(np.r_[False, (kind[1:] == UPPER) & (kind[:-1] == LETTER)])
    line_hash = hashes(code, a, b, 64) ^ (doc.astype(np.uint64) * PRIME)
    order = np.argsort(line_hash, kind="stable")
    seen = np.zeros(n, bool)
    if n:
        seen[order] = np.r_[False, line_hash[order][1:] == line_hash[order][:-1]]
    starts_same = (same_doc & (prev(code[a]) == code[a]) & (prev(code[np.minimum(a + 1, b - 1)]) == code[np.minimum(a + 1, b - 1)])) | (next_same & (follow(code[a]) == code[a]) & (follow(code[np.minimum(a + 1, b - 1)]) == code[np.minimum(a + 1, b - 1)]))
    score = np.zeros(n)
    if pairs is not None and len(w0) > 1:
        near = (word_line[1:] == word_line[:-1]) & (w0[1:] - w1[:-1] <= 2)
        value = np.where(near, pairs[word_id[:-1], word_id[1:]], 0.0)
        got = np.bincount(word_line[1:], near.astype(np.float64), minlength=n)
        score = np.bincount(word_line[1:], value, minlength=n) / (got + 2)
    f = n_filled.astype(np.float64)
    some = np.maximum(words, 1)
    features = np.stack([
        np.log1p(span), letters / f, table[:, DIGIT] / f, table[:, SYMBOL] / f, table[:, ODD] / f, table[:, END] / f, table[:, MINOR] / f, table[:, UPPER] / np.maximum(letters, 1), 1 - f / span,
        np.log1p(in_words / some), commons / some, ends_well, (k0 == LETTER) | (k0 == UPPER), k0 == UPPER, marked,
        np.minimum(most / some, 3), same_separators, wide_gaps, repeats / span, switches / span, seen, starts_same, np.log1p(words), np.log1p(longest), count(code == ord(":")) / some, case_switch / np.maximum(letters, 1), (words <= 1), np.log(np.maximum(words, 1) / np.maximum(distinct, 1)), score], axis=1).astype(np.float64)
    return Lines(doc, span.astype(np.int64), features, words.astype(np.int64), in_words.astype(np.int64), commons.astype(np.int64), table[:, END:].sum(1).astype(np.int64), n_filled.astype(np.int64), ends_well, word_line, word_id)
