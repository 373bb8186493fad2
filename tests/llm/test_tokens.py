"""Ids against the library on whole texts, and exact round trips."""

import random

from siltstone.llm import tokens as m

PATH = m.vocabulary_path()


def texts():
    rng = random.Random(11)
    odd = [" ", " ", "\x85", "\x1c", "\r\n", "\t", "  ", "'s", "’", "é", "é", "中", "😀", "\U0001f9d1‍\U0001f680", "﻿", "՘", "\U000e0001", "9", "<|endoftext|>", "word", " ", " ", "\n", "\n\n", "　", "᠎", "\x00", ".", "--"]
    return [None, "", " ", "  ", "\n", " a", "a ", "<|endoftext|>", "x" * 5000, "ab " * 3000] + ["".join(rng.choice(odd) for _ in range(rng.randint(1, 60))) for _ in range(400)]


def test_ids_equal_the_library(spark):
    t = texts()
    whole = m.Encoder(PATH).tokenizer
    rows = m.encode(spark.createDataFrame([(i, x, [0]) for i, x in enumerate(t)], "doc_id bigint, text string, ids array<int>"), PATH).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: whole.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(t)}


def test_every_single_character_keeps_its_cut():
    e, whole = m.Encoder(PATH), m.Encoder(PATH).tokenizer
    every = [f"a {chr(c)} b{chr(c)} c" for c in [*range(0x3100), *range(0xFE00, 0x10000), *range(0x1F000, 0x1FA00), 0xE0001]]
    for i in range(0, len(every), 2000):
        part = every[i : i + 2000]
        assert e.encode(part) == [x.ids for x in whole.encode_batch_fast(part, add_special_tokens=False)]


def test_round_trip_and_split_characters(spark):
    t = texts()
    docs = spark.createDataFrame(list(enumerate(t)), "doc_id bigint, text string")
    back = {r.doc_id: r.text for r in m.decode(m.encode(docs, PATH), PATH).collect()}
    assert back == {i: x or "" for i, x in enumerate(t)}
    e = m.Encoder(PATH)
    ids = e.encode(["😀"])[0]
    assert len(ids) > 1 and e.decode(ids[:1]) == "�" and e.decode([-1, 10**9]) == "" and e.decode(None) == ""


def test_spans_cover_the_text(spark):
    t = [x for x in texts() if x]
    rows = m.token_spans(spark.createDataFrame(list(enumerate(t)), "doc_id bigint, text string"), PATH).collect()
    e = m.Encoder(PATH)
    for r in rows:
        ids = e.encode([t[r.doc_id]])[0]
        assert len(r.starts) == len(r.ends) == len(ids) and r.starts[0] == 0 and r.ends[-1] == len(t[r.doc_id])
        for s, n, i in zip(r.starts, r.ends, ids):
            assert e.bytes_of[i] in t[r.doc_id][s:n].encode()


def test_sizes_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, "a b")], "doc_id bigint, text string")
    assert sorted(map(tuple, m.count_tokens(docs, PATH).collect())) == [(1, 0), (1, 0), (2, 2)]
    assert m.encode(docs.limit(0), PATH).collect() == []
