"""Column expressions on texts: tidying, folding, tokens, estimates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import fixed

BLANKS = "[ \\t\\x0b\\f\\xa0]"


def tidy(text: Column) -> Column:
    """Carriage returns, control characters and signatures dropped, blanks collapsed, one newline kept, more made a blank line, ends trimmed."""
    t = F.regexp_replace(text, "[\\x00-\\x08\\x0e-\\x1f\\r\\x{FEFF}]", "")
    t = F.regexp_replace(t, f"{BLANKS}*\\n{BLANKS}*\\n[ \\t\\x0b\\f\\xa0\\n]*", "\x01")  # no control character is left
    t = F.regexp_replace(t, f"{BLANKS}*\\n{BLANKS}*", "\n")
    t = F.regexp_replace(t, f"{BLANKS}+", " ")
    t = F.regexp_replace(t, "^[ \\n\\x01]+|[ \\n\\x01]+\\z", "")
    return F.replace(t, F.lit("\x01"), F.lit("\n\n"))


def fold_map() -> tuple[str, str]:
    """Letters of ASCII, Latin-1, Latin Extended-A, Greek and Cyrillic and what they fold to, one character each."""
    src, dst = [], []
    for cp in [*range(0x41, 0x5B), *range(0xC0, 0x180), *range(0x391, 0x3AA), *range(0x400, 0x430)]:
        c = chr(cp)
        low = c.lower()[0]
        if not c.isalpha() or low in fixed.FOLD_MORE:
            continue
        if cp < 0x180:
            base = fixed.FOLD_ONE.get(low) or unicodedata.normalize("NFD", low)[0]
        else:
            base = chr(cp + (0x50 if 0x400 <= cp < 0x410 else 0x20))
        if base != c:
            src.append(c)
            dst.append(base)
    return "".join(src) + marks(), "".join(dst)  # what has no counterpart is dropped


def marks() -> str:
    """The combining marks that vanish, by their blocks."""
    return "".join(chr(c) for a, b in fixed.MARK_BLOCKS for c in range(a, b + 1))


def fold(text: Column) -> Column:
    """Lower case without diacritics; combining marks vanish. Texts of ASCII alone take a short way to the same."""
    t = F.translate(text, *fold_map())
    for c, more in fixed.FOLD_MORE.items():
        for one in dict.fromkeys((c, c.upper())):
            t = F.replace(t, F.lit(one), F.lit(more)) if len(one) == 1 else t
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(t)


def tokens(text: Column) -> Column:
    """The folded tokens of a text in order: runs of letters, digits and underscores."""
    return F.regexp_extract_all(fold(text), F.lit(f"{fixed.TOKEN}+"), F.lit(0))


def token_units(text: Column) -> Column:
    """The estimated size of a text in sixteenths of a token."""
    u = fixed.UNIT
    n = lambda c: F.regexp_count(text, F.lit(c))
    space, letter, digit = n("[ \\t\\n\\r\\f\\x0b]"), n("[A-Za-z]"), n("[0-9]")
    ascii_ = n("[\\x00-\\x7f]")
    two, three, four = n("[\\x{80}-\\x{7FF}]"), n("[\\x{800}-\\x{FFFF}]"), n("[\\x{10000}-\\x{10FFFF}]")
    return space * u["space"] + letter * u["letter"] + digit * u["digit"] + (ascii_ - space - letter - digit) * u["symbol"] + two * u["two"] + three * u["three"] + four * u["four"]


def tokenizable(text: Column) -> Column:
    """False where a run of more than 1,024 letters and digits, or of more than 256 blanks or other characters, stands."""
    bad = "[A-Za-z0-9\\x{80}-\\x{10FFFF}]{1025}|[ \\t\\n\\r\\f\\x0b]{257}|[^A-Za-z0-9 \\t\\n\\r\\f\\x0b\\x{80}-\\x{10FFFF}]{257}"
    return ~text.rlike(bad)


def worth_asking(query: Column, filters: Column) -> Column:
    """Whether a question is worth a model: no filters, three words or more, at most 200 characters."""
    words = 1 + F.regexp_count(query, F.lit(" "))
    return ~filters & (words >= 3) & (F.char_length(query) <= 200)
