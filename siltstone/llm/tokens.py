"""Encoding a corpus with a public byte-level tokenizer, and decoding it again.

Texts go through the ``tokenizers`` library in Arrow batches. A byte-level pre-tokenizer never joins what stands before and
behind a single space between two non-blanks, so texts are cut there and each distinct cut is encoded once
per batch and remembered, within a bound. Texts with characters that Unicode versions class differently are cut the same
way: only blanks matter to a cut.

Tokens are spelled in the characters that byte-level vocabularies put for bytes; the table is built by its rule, and decoding
reverses it. A character may be split over several tokens.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.json"
KEEP, LONGEST = 200_000, 96  # cuts remembered by a Python worker, and their greatest length
CUT = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The place of a public vocabulary file: $TOKENIZERS_DIR, else the installed public_tokenizers."""
    if os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(os.environ["TOKENIZERS_DIR"], name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next one from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Encoder:
    """One per Python worker and vocabulary file."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their spellings in a text are ordinary text
        self.memory: dict[str, tuple[int, ...]] = {}
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            if all(c in to_byte for c in token):
                self.bytes_of[i] = bytes(to_byte[c] for c in token)

    @classmethod
    def get(cls, path: str) -> Encoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; null and empty texts have none."""
        cuts = []
        for t in texts:
            parts = CUT.split(t) if t else []
            # all but the first have lost the space before them, a key of their own
            cuts.append([parts[0], *[" " + p for p in parts[1:]]] if parts else parts)
        memory = self.memory
        new = list({p for c in cuts for p in c if p not in memory})
        once = {}
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            (memory if len(p) <= LONGEST else once)[p] = tuple(e.ids)
        out = [list(chain.from_iterable(memory[p] if p in memory else once[p] for p in c)) for c in cuts] if once else [list(chain.from_iterable(map(memory.__getitem__, c))) for c in cuts]
        if len(memory) > KEEP:
            memory.clear()
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The text of a list of ids; bytes that form no character (a list cut inside one) become U+FFFD.

        Ids outside the vocabulary stand for nothing.
        """
        b = self.bytes_of
        return b"".join(b[i] for i in ids or () if i is not None and 0 <= i < len(b)).decode("utf-8", "replace")

    def spans(self, text: str | None, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in characters; a token with a part of a character spans all of it."""
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)
        raw = np.frombuffer((text or "").encode(), np.uint8)
        char = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, 0)  # of each byte
        starts = np.append(0, ends[:-1]) if len(ends) else ends
        return char[starts], char[ends - 1] + 1


def _lists(rows: list, kind: pa.DataType) -> pa.ListArray:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = np.concatenate(rows) if rows and isinstance(rows[0], np.ndarray) else np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _slices(batches: Iterator[pa.RecordBatch], limit: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Batches with at most ``limit`` bytes of text, at least one row each."""
    for b in batches:
        rows = max(1, min(b.num_rows, int(b.num_rows * limit / max(b.nbytes, 1))))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _mapped(df: DataFrame, cols: list[str], fields: str, make) -> DataFrame:
    """df's own columns ``cols`` (the id first) through make(columns as lists) in Arrow batches."""
    kind = df.schema[cols[0]].dataType.simpleString()
    name = cols[0]

    def run(batches):
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *make(*[b.column(i).to_pylist() for i in range(1, len(cols))])], names=[name, *[f.split()[0] for f in fields.split(", ")]])

    return df.select(*cols).mapInArrow(run, f"`{name}` {kind}, {fields}")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row, without special tokens; null and empty texts have an empty list.

    Rows are taken one by one, so repeated ids stay; other columns are not read.
    """
    return _mapped(docs, [id_col, text_col], "ids array<int>", lambda t: [_lists(Encoder.get(path).encode(t), pa.int32())])


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens bigint): the sizes alone, so that no ids are moved."""
    return _mapped(docs, [id_col, text_col], "n_tokens bigint", lambda t: [pa.array([len(i) for i in Encoder.get(path).encode(t)], pa.int64())])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text); a null list gives an empty text."""
    return _mapped(encoded, [id_col, ids_col], "text string", lambda ids: [pa.array([Encoder.get(path).decode(i) for i in ids], pa.string())])


def token_spans(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, starts array<bigint>, ends array<bigint>): the characters of the text that each token touches."""

    def make(texts):
        e = Encoder.get(path)
        spans = [e.spans(t, i) for t, i in zip(texts, e.encode(texts))]
        return [_lists([s[k] for s in spans], pa.int64()) for k in (0, 1)]

    return _mapped(docs, [id_col, text_col], "starts array<bigint>, ends array<bigint>", make)
