"""Cuts against a cutter that walks the bytes, stored pieces against the contract's words."""

import random

from siltstone.llm import pieces as m

LIMIT = m.PieceLimit(200, 16, 120)


def head(b, i):
    return i >= len(b) or b[i] & 0xC0 != 0x80


def natural(b, p):
    return p == len(b) or b[p - 1 : p] in (b"\n", b" ") or (b[p - 1 : p] in (b".", b"!", b"?", b";") and b[p : p + 1] in (b" ", b"\n"))


def cut(b, limit):
    out, start = [], 0
    while b:
        if len(b) - start <= limit.capacity:
            return out + [(start, len(b) - start)]
        window = range(start + limit.capacity, start + limit.window_from - 1, -1)
        tests = [lambda p: b[p - 2 : p] == b"\n\n", lambda p: b[p - 1 : p] == b"\n", lambda p: b[p - 1 : p] in (b".", b"!", b"?", b";") and b[p : p + 1] in (b" ", b"\n"), lambda p: b[p - 1 : p] == b" "]
        end = next((p for t in tests for p in window if t(p)), None) or next(p for p in window if head(b, p))
        out.append((start, end - start))
        start = end - limit.overlap
        while not head(b, start):
            start -= 1
    return out


def texts(seed=3):
    rng = random.Random(seed)
    kinds = ["abc", "abc     ", "abé€😀 .", "a\n.", "é", "😀", "word. ", "ab!?; \n\n\r\x85 "]
    return [None, "", " ", "a"] + ["".join(rng.choice(k) for _ in range(n)) for k in kinds for n in (50, 199, 201, 230, 700, 1500)]


def test_cuts_equal_a_walk(spark):
    t = texts()
    rows = m.split_texts(spark.createDataFrame(list(enumerate(t)), "doc_id int, text string"), LIMIT).orderBy("doc_id", "seq").collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.boff, r.blen))
    assert got == {i: cut(x.encode(), LIMIT) for i, x in enumerate(t) if x}


def test_own_pieces_are_sound(spark):
    docs = spark.createDataFrame([(i, x, i, 0) for i, x in enumerate(texts())], "doc_id bigint, text string, boff int, blen int")
    own = m.split_texts(docs, LIMIT).selectExpr("doc_id * 1000 + seq as chunk_id", "doc_id", "boff", "blen")
    assert m.judge_pieces(own, docs, LIMIT).filter("not sound").count() == 0


def brute(chunks, docs, limit):
    bad, by = set(), {}
    for c in chunks:
        by.setdefault(c[1], []).append(c)
    for d, rows in by.items():
        b = (docs.get(d) or "").encode()
        rows.sort(key=lambda c: (c[2] is not None, c[2] or 0, c[0]))
        for i, (k, _, o, n) in enumerate(rows):
            ok = o is not None and n is not None and 0 < n <= limit.capacity and o >= 0 and o + n <= len(b) and head(b, o) and head(b, o + n)
            if ok:
                e = o + n
                if i == 0:
                    ok = o == 0
                else:
                    po, pn = rows[i - 1][2], rows[i - 1][3] or 0
                    ok = po is not None
                    if ok:
                        s = min(po + pn, len(b)) - min(limit.overlap, max(pn, 0) // 4)
                        while 0 < s < len(b) and not head(b, s):
                            s -= 1
                        ok = o == s
                last = i == len(rows) - 1
                ok = ok and (e == len(b) or (not last and (natural(b, e) or not any(natural(b, p) for p in range(o + limit.window_from, min(o + limit.capacity, len(b)) + 1)))))
            if not ok:
                bad.add(k)
    return bad


def test_judgement_equals_the_contract(spark):
    rng = random.Random(5)
    t = dict(enumerate(texts()))
    t |= {100: "x. y " * 9000, 101: "é" * 30000}  # more than one segment
    chunks, k = [], 0
    for d, x in t.items():
        for o, n in cut((x or "").encode(), LIMIT) or [(0, 5)]:
            k += 1
            r = rng.random()
            if r < 0.3:
                o, n = rng.choice([(o + rng.randint(-3, 3), n), (o, n + rng.randint(-200, 90)), (None, n), (o, None), (o, -n), (o, 0), (-o, n), (o, 2**62), (2**62, n)])
            chunks.append((k, d, o, n))
            if rng.random() < 0.03:
                chunks.append((10**6 + k, d, o, n))
    chunks += [(9 * 10**6, 555, 0, 3)]
    c = spark.createDataFrame([(*x, "clash") for x in chunks], "chunk_id bigint, doc_id bigint, boff bigint, blen bigint, text string")
    docs = spark.createDataFrame(list(t.items()), "doc_id bigint, text string")
    got = {r.chunk_id for r in m.judge_pieces(c, docs, LIMIT).filter("not sound").collect()}
    assert got == brute(chunks, t, LIMIT)


def test_empty_tables(spark):
    docs, c = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "chunk_id bigint, doc_id bigint, boff bigint, blen bigint")
    assert m.split_texts(docs).count() == 0 and m.judge_pieces(c, docs).count() == 0
    assert m.piece_limit(spark.createDataFrame([], "limit_name string, capacity int, overlap int, window_from int")) == m.PieceLimit()
