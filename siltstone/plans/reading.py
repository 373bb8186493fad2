"""What is read out of files and texts by Arrow functions, as queries over whole tables; SQL where it can state them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import extract, passages
from siltstone.functions import text as text_columns
from siltstone.functions.stems import stems
from siltstone.session import table

TERM = "garden"


def mapped(df: DataFrame, id_col: str, value_col: str, fields: str, make) -> DataFrame:
    """(id, fields) by a Python function of one value, in Arrow batches; nulls give nulls. make returns a tuple."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}
    kinds = [types[f.strip().split(" ")[1]] for f in fields.split(",")]

    def run(batches):
        for b in batches:
            rows = [make(v) if v is not None else (None,) * len(names) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=[id_col, *names])

    return df.select(id_col, value_col).mapInArrow(run, f"`{id_col}` {kind}, {fields}")


def _bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "kind", F.encode("text", "UTF-8").alias("raw"))


def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return passages.chunked(table(spark, d, "documents"))


def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return mapped(table(spark, d, "documents"), "doc_id", "text", "plain string", lambda t: (extract.strip_markup(t),))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return mapped(table(spark, d, "documents"), "doc_id", "text", "plain string", lambda t: (extract.tidy(extract.html_text(t)),))


def html_charset(spark: SparkSession, d: str) -> DataFrame:
    return mapped(_bytes(spark, d), "doc_id", "raw", "codec string", lambda b: (extract.html_charset(b),))


def detect_encoding(spark: SparkSession, d: str) -> DataFrame:
    return mapped(_bytes(spark, d), "doc_id", "raw", "encoding string", lambda b: (extract.detect_encoding(b),))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """The texts out of their UTF-16 bytes again, tidied: what tidy_text gives."""
    raw = table(spark, d, "documents").select("doc_id", F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-16LE")).alias("raw"))
    return mapped(raw, "doc_id", "raw", "tidy string", lambda b: (extract.tidy(extract.decoded(b) or ""),))


def rtf_text(spark: SparkSession, d: str) -> DataFrame:
    """The texts put into rich text by rule and read out of it again."""
    t = F.translate(F.regexp_replace("text", r"([\\{}])", r"\\$1"), "\r\n", "")
    rich = table(spark, d, "documents").select("doc_id", F.encode(F.concat(F.lit("{\\rtf1\\ansicpg65001 "), t, F.lit("}")), "UTF-8").alias("raw"))
    return mapped(rich, "doc_id", "raw", "plain string", lambda b: (extract.rtf_text(b),))


def extract_status(spark: SparkSession, d: str) -> DataFrame:
    """How the readers of each kind fare; the texts are taken as the files' bytes."""
    e = extract.extracted(_bytes(spark, d).select("doc_id", "kind", "raw"), "doc_id", "kind", "raw")
    return e.join(table(spark, d, "documents").select("doc_id", "kind"), "doc_id").groupBy("kind", "status").agg(F.count("*").alias("files"))


def worker_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a broken package, book and rich text: each row keeps its place and says what went wrong."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array(*[F.lit(k) for k in (5, 7, 8, 9)])).alias("kind"), F.concat(F.lit(b"PK\x03\x04"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("raw"))
    e = extract.extracted(docs, "doc_id", "kind", "raw")
    return e.groupBy("status").agg(F.count("*").alias("files"), F.count_distinct("doc_id").alias("docs"))


def identifier_parts(spark: SparkSession, d: str) -> DataFrame:
    return mapped(table(spark, d, "documents"), "doc_id", "text", "parts array<string>", lambda t: (passages.identifier_parts(t),))


def stem_terms(spark: SparkSession, d: str) -> DataFrame:
    """The stems of every distinct term of the corpus."""
    terms = table(spark, d, "documents").select(F.explode(text_columns.tokens(F.col("text"))).alias("term")).filter("term <> ''").distinct()
    return mapped(terms.withColumn("t", F.col("term")), "term", "t", "stems array<string>", lambda t: (stems(t),))


def snippet(spark: SparkSession, d: str) -> DataFrame:
    """Previews of the documents' stored chunks around a term."""
    c = table(spark, d, "chunk").filter("boff >= 0 and blen > 0").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").filter("text is not null")
    v = F.struct("text", "boff", "blen").alias("v")
    return mapped(c.select("chunk_id", v), "chunk_id", "v", "preview string", lambda x: (passages.snippet(x["text"], x["boff"], x["blen"], [TERM]),))


def highlight(spark: SparkSession, d: str) -> DataFrame:
    return mapped(table(spark, d, "documents"), "doc_id", "text", "marked string", lambda t: (passages.highlight(t, TERM),))


_ALL = (chunk_text, strip_markup, html_text, html_charset, detect_encoding, normalize_text, rtf_text, extract_status, worker_faults, identifier_parts, stem_terms, snippet, highlight)
QUERIES = {f.__name__: f for f in _ALL}

from siltstone.plans.search import SQL as _SEARCH  # noqa: E402

SQL = {
    "normalize_text": _SEARCH["tidy_text"],
    "rtf_text": "select doc_id, replace(replace(text, chr(13), ''), chr(10), '') as plain from documents",
    "highlight": f"""select doc_id, regexp_replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '({TERM})', '<mark>\\1</mark>', 'gi') as marked from documents""",
}
