"""Folders as tables, versioned tables, and paths."""

from pyspark.sql import functions as F

from siltstone.functions import names
from siltstone.sources import files


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.txt": b"h\xe9llo", "sub/b.html": b"<p>one<p>two", "empty.txt": b"", "c.bin": b"x", "d.txt": b"%PDF-1.7", "e.docx": b"GIF89a", "big.rtf": b"{\\rtf1 x}"}.items():
        (tmp_path / name).write_bytes(data)
    kinds = {r.name: r.kind for r in files.listing(spark, str(tmp_path)).collect()}
    assert kinds == {"a.txt": 1, "b.html": 3, "c.bin": 0, "d.txt": 1, "e.docx": 5, "big.rtf": 8}
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.text) for r in files.texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("ok", "héllo"), "b.html": ("ok", "one\ntwo"), "d.txt": ("unavailable", None), "e.docx": ("ok", "GIF89a"), "big.rtf": ("ok", "x")}


def test_generations(spark, tmp_path):
    root, df = str(tmp_path / "t"), spark.range(3)
    assert files.load_table(spark, root) is None
    assert files.save_table(df, root, {"model": 1}) == 1 and files.save_table(df.filter("id < 2"), root, {"model": 2}) == 2
    assert files.load_table(spark, root, {"model": 2}).count() == 2 and files.load_table(spark, root, {"model": 1}) is None
    spark.range(9).write.parquet(f"{root}/gen=3/data")  # a save that did not end
    assert files.load_table(spark, root).count() == 2 and files.save_table(df, root, {}) == 3


def test_paths(spark):
    rows = [("c:\\users\\alice\\a.txt", True), ("c:\\users\\alice-old\\a.txt", False), ("C:\\Users\\Alice", False), ("C:\\USERS\\alice\\x", True), ("c:\\users\\alice\\", False), (None, None)]
    df = spark.createDataFrame(rows, "p string, want boolean")
    for folder in ("c:\\users\\alice", "C:\\Users\\Alice\\"):
        assert all(r.got == r.want for r in df.withColumn("got", names.inside_folder(F.col("p"), F.lit(folder))).collect())


def test_names(spark):
    rows = [("a.PDF", 4, "pdf"), ("noext", 0, ""), ("dot.", 0, ""), (".txt", 1, "txt"), ("x.tar.gz", 0, "gz"), ("", 0, ""), (None, 0, None)]
    df = spark.createDataFrame([(n,) for n, _, _ in rows], "n string").select("n", names.kind_of(F.col("n")).alias("k"), names.extension(F.col("n")).alias("e"))
    assert {r.n: (r.k, r.e) for r in df.collect()} == {n: (k, e) for n, k, e in rows}
    r = spark.range(1).select(*[names.name_relevance(F.lit(n), "invoice").alias(f"c{i}") for i, n in enumerate(["invoice", "Invoice 2", "new-invoice", "xinvoicex", "other"])]).head()
    assert r.c0 > r.c1 > r.c2 > r.c3 > r.c4 == 0.0 and abs(r.c0 - (1 + 6 + 3 - 0.028)) < 1e-9


def test_phrases_and_stems(spark):
    from siltstone.operators import fulltext as t

    docs = spark.createDataFrame([(1, "The contracts of l'anno"), (2, "a contract; L'ANNO contract"), (3, "anno l contratto"), (4, None), (5, ""), (6, "contract_s anno")], "doc_id bigint, text string")
    index = t.postings(docs)
    found = lambda i, w: sorted((r.doc_id, r.phrase, r.tf) for r in t.matches(i, w).collect())
    assert t.split_query('l\'anno "exact phrase" -- x "open') == ["l'anno", "exact phrase", "x", "open"]
    assert found(index, t.phrases(spark, "l'anno contract")) == [(2, 0, 1), (2, 1, 2)]
    assert found(t.with_stems(index), t.alternatives(t.phrases(spark, "l'anno contract"))) == [(1, 0, 1), (1, 1, 1), (2, 0, 1), (2, 1, 2)]
    assert found(index, []) == [] and t.phrases(spark, "-- ?") == []
    assert {r.doc_id: r.dl for r in t.lengths(docs).collect()} == {1: 5, 2: 5, 3: 3, 4: 0, 5: 0, 6: 2}
    one, sizes = t.prepared(docs, [["anno"]])
    assert sorted((r.doc_id, r.pos) for r in one.collect()) == sorted((r.doc_id, r.pos) for r in index.filter("term = 'anno'").collect())
    assert sizes.count() == 6 and t.scored(one, sizes, []).count() == 0
