"""Line statistics against plain Python, labelled shapes against held-out labels."""

import duckdb
import numpy as np

from siltstone.llm import quality as m
from siltstone.llm.linestats import lines, word_hash

D = "/root/testdata/sf0.1"


def test_hashes_of_words():
    common = np.unique(word_hash(["the", "Été", "von"]))
    x = lines(["THE cat, été!", "", "von von vonn"], common)
    assert x.words.tolist() == [3, 3] and x.common.tolist() == [2, 2] and x.doc.tolist() == [0, 2]


def test_statistics_of_odd_texts(spark):
    texts = [None, "", " \n\t ", "One two.\n\n three", "áb  c!", "x" * 100000, "\n" * 500 + "Z?", "😀 \U0010ffff", "…", "word", "word"]
    docs = spark.createDataFrame([(i % 10, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, prose int")
    common = spark.createDataFrame([("en", "two", 1), ("en", None, 2), (None, "WORD", 3)], "lang string, word string, word_rank int")
    rows = sorted(map(tuple, m.statistics(docs, common).collect()), key=str)
    assert rows == sorted([
        (0, 0, None, None, None, None), (1, 0, None, None, None, None), (2, 0, None, None, None, None), (3, 3, 11 / 3, 1 / 12, 0.5, 1 / 3), (4, 2, 2.0, 0.2, 1.0, 0.0),
        (5, 1, 100000.0, 0.0, 0.0, 0.0), (6, 1, 1.0, 0.5, 1.0, 0.0), (7, 0, None, 1.0, 0.0, None), (8, 0, None, 1.0, 1.0, None), (9, 1, 4.0, 0.0, 0.0, 1.0), (0, 1, 4.0, 0.0, 0.0, 1.0)], key=str)


def test_most_likely_sequence_equals_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    e, first, follow = rng.normal(size=(9, 4)), rng.normal(size=4), rng.normal(size=(4, 4))
    doc = np.array([0] * 5 + [2] + [3] * 3)
    want = []
    for d in (0, 2, 3):
        x = e[doc == d]
        want += max(itertools.product(range(4), repeat=len(x)), key=lambda s: first[s[0]] + sum(x[i, s[i]] for i in range(len(x))) + sum(follow[a, b] for a, b in zip(s, s[1:])))
    assert m.most_likely(e, doc, first, follow).tolist() == want


def test_held_out_labels(spark):
    labels, docs, common = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("text_label", "documents", "common_word"))
    model = m.fit(labels.filter("doc_id % 2 = 0"), docs, common)
    truth = dict(duckdb.sql(f"select doc_id, max(shape) <> 'prose' from '{D}/text_label.parquet' where doc_id % 2 = 1 group by doc_id having count(distinct shape) = 1 and count(*) > 1").fetchall())
    asked = docs.filter(docs.doc_id.isin(list(truth)) & (docs.text != ""))
    found = {r.doc_id for r in m.not_prose(m.shapes(asked, model)).collect()}
    right = [truth[r.doc_id] == (r.doc_id in found) for r in asked.select("doc_id").collect()]
    assert len(right) > 80 and np.mean(right) > 0.9


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, annotator string, shape string")
    common = spark.createDataFrame([], "lang string, word string, word_rank int")
    model = m.fit(labels, docs, common)
    assert m.not_prose(m.shapes(docs, model)).count() == 0
    tied = spark.createDataFrame([(1, "a", "junk"), (1, "b", "list"), (1, "b", "odd"), (None, "a", "list"), (2, "a", "list")], "doc_id bigint, annotator string, shape string")
    assert m.labelled(tied, docs).count() == 0
    assert m.shapes(docs.limit(0), model).count() == 0
