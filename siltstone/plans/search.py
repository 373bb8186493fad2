"""Names, words, meaning and their fusion as queries over the test tables, with SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import fixed, names, text
from siltstone.operators import fulltext, fusion, planner
from siltstone.session import table

NEEDLE = "letter"
WORDS = 'contract "every shared"'
LINE, NOW = "letter pdf 2025", datetime(2026, 7, 28)
QUESTIONS = [
    "il pdf del contratto di marzo", "foto nei download", "contratto noleggio", "tipo:xlsx tasse", "foto", "This Is Us", "la casa",
    "where is the spreadsheet with the invoices", "la fattura, in pdf, di ieri?", "relazione 2024", "modulo 1234", "last week slides", "letter pdf 2025"]


def document_files(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, name, path, mtime, rank_penalty): the documents as files; unknown times are null."""
    path = F.concat(F.lit("c:\\"), F.replace(F.coalesce("source", F.lit("")), F.lit("/"), F.lit("\\")), F.lit("\\"), F.coalesce("file_name", F.lit("")))
    docs = table(spark, d, "documents").select("doc_id", F.col("file_name").alias("name"), path.alias("path"))
    mtime = F.when(F.col("mtime") > 0, F.timestamp_micros(F.floor((F.col("mtime") - 116444736000000000) / 10)))
    return docs.join(table(spark, d, "doc").select("doc_id", mtime.alias("mtime"), "rank_penalty"), "doc_id", "left")


def name_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "file_name").filter(F.contains(F.lower("file_name"), F.lit(NEEDLE)))


def _relevant(files: DataFrame, name: str) -> DataFrame:
    hits = files.filter(F.contains(F.lower(name), F.lit(NEEDLE)))
    return hits.withColumn("relevance", F.round(names.name_relevance(F.col(name), NEEDLE), 9))


def name_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _relevant(table(spark, d, "documents").select("doc_id", "file_name"), "file_name")


def name_topk(spark: SparkSession, d: str) -> DataFrame:
    return name_relevance(spark, d).orderBy(F.desc("relevance"), "doc_id").limit(fixed.NAME_ROWS)


def ext_kind(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("file_name")
    kind = names.kind_of(n)
    return table(spark, d, "documents").select("doc_id", names.extension(n).alias("ext"), kind.alias("kind_by_name"), names.needs_extractor(kind).alias("needs_extractor"))


def rank_penalty(spark: SparkSession, d: str) -> DataFrame:
    return document_files(spark, d).select("doc_id", names.rank_penalty(F.col("path")).alias("penalty"))


def anon_path(spark: SparkSession, d: str) -> DataFrame:
    return document_files(spark, d).select("doc_id", names.anonymous(F.col("path"), "c:\\projects", "c:\\~").alias("shown"))


def tidy_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.tidy(F.col("text")).alias("tidy"))


def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


def tokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    t = F.filter(text.tokens(F.col("text")), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.size(F.coalesce(t, F.array().cast("array<string>"))).alias("n_tokens"), F.get(t, F.lit(0)).alias("first_token"))


def postings(spark: SparkSession, d: str) -> DataFrame:
    """Per term, in how many documents and how often it stands."""
    return fulltext.postings(table(spark, d, "documents")).groupBy("term").agg(F.count_distinct("doc_id").alias("df"), F.count("*").alias("cf"), F.sum("pos").alias("positions"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.postings(table(spark, d, "documents"))


def fts_and(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.matches(_index(spark, d), fulltext.phrases(spark, "contract garden")).select("doc_id").distinct()


def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.matches(_index(spark, d), fulltext.phrases(spark, WORDS)).select("doc_id", "phrase", "tf")


def fts_stems(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold both words in any form with the same stem."""
    index = fulltext.with_stems(_index(spark, d))
    return fulltext.matches(index, fulltext.alternatives(fulltext.phrases(spark, "contracts gardens"))).groupBy("doc_id").agg(F.sum("tf").alias("tf"))


def fts_count(spark: SparkSession, d: str) -> DataFrame:
    return fts_and(spark, d).agg(F.count("*").alias("n"))


def fts_bm25(spark: SparkSession, d: str) -> DataFrame:
    wanted = fulltext.phrases(spark, WORDS)
    return fulltext.scored(*fulltext.prepared(table(spark, d, "documents"), wanted), wanted).select("doc_id", F.round("score", 9).alias("score"))


def _chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, doc_id, text): the stored ranges as text; ranges outside the text hold what there is of them."""
    raw = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    c = table(spark, d, "chunk").filter("boff >= 0 and blen > 0").join(raw, "doc_id")
    return c.select("chunk_id", "doc_id", F.decode(F.substring("raw", (F.col("boff") + 1).cast("int"), F.col("blen").cast("int")), "ISO-8859-1").alias("text"))


def fts_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks searched, documents given: content_hit's own rows grouped by the rules of a search."""
    hits = table(spark, d, "content_hit").filter("score is not null").select("query_id", F.col("best_chunk_id").alias("chunk_id"), "doc_id", "score").distinct()
    first = hits.filter(F.col("query_id") == 1)
    return fulltext.documents(first, table(spark, d, "doc")).select("doc_id", F.round("score", 9).alias("score"), "passages", "best_chunk_id")


def chunk_doc_join(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "doc").select("doc_id", "volume_id", "frn")
    return table(spark, d, "chunk").join(docs, "doc_id").select("chunk_id", "doc_id", "volume_id", "frn", "boff", "blen")


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk").groupBy("doc_id").agg(F.count("*").alias("n"))
    j = table(spark, d, "doc").select("doc_id", "kind").join(chunks, "doc_id", "left")
    return j.groupBy("kind").agg(F.count("*").alias("docs"), F.count("n").alias("chunked"), F.sum(F.coalesce("n", F.lit(0))).alias("chunks"))


def chunk_dup_stats(spark: SparkSession, d: str) -> DataFrame:
    t = _chunk_texts(spark, d).select(F.sha2("text", 256).alias("h"))
    return t.groupBy("h").count().agg(F.sum("count").alias("total"), F.count("*").alias("distinct_chunks"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.token_units(F.col("text")).alias("units"))


def token_histogram(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.ceil(text.token_units(F.col("text")) / fixed.UNITS_A_TOKEN)
    t = table(spark, d, "documents").filter("text is not null").select(tokens.alias("n"))
    bucket = F.when(F.col("n") <= 64, "1-64").when(F.col("n") <= 128, "65-128").when(F.col("n") <= 256, "129-256").when(F.col("n") <= 512, "257-512").otherwise("513+")
    return t.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("docs"))


def embed_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.tokenizable(F.col("text")).alias("fit"))


def embed_order(spark: SparkSession, d: str) -> DataFrame:
    group = F.when(F.coalesce("rank_penalty", F.lit(0.0)) > 0, 3).when(F.col("kind").between(4, 9), 0).when(F.col("kind") == 2, 2).otherwise(1)
    return table(spark, d, "doc").select("doc_id", group.alias("pass")).orderBy("pass", "doc_id")


def embed_resume(spark: SparkSession, d: str) -> DataFrame:
    """Documents that still need vectors: those whose chunks do not all have one; a wrong number of chunks leaves a document out."""
    have = table(spark, d, "chunk_vector").filter("vec is not null and size(vec) > 0").select("chunk_id").distinct().withColumn("has", F.lit(1))
    c = table(spark, d, "chunk").join(have, "chunk_id", "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.count("has").alias("done"))
    j = table(spark, d, "doc").select("doc_id", "chunk_count").join(c, "doc_id")
    return j.filter("n = chunk_count and done < n").select("doc_id", "n", "done")


def embed_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk and the first chunk with the same text, whose vector it can take."""
    t = _chunk_texts(spark, d).select("chunk_id", F.sha2("text", 256).alias("h"))
    first = t.groupBy("h").agg(F.min("chunk_id").alias("source_id"))
    return t.join(first, "h").select("chunk_id", "source_id")


def vec_votes(spark: SparkSession, d: str) -> DataFrame:
    return fusion.meaning_votes(table(spark, d, "neighbor"), table(spark, d, "chunk"), table(spark, d, "doc"), ["query_id"], 0.5)


def _word_list(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "content_hit").filter("score is not null").groupBy("query_id", "doc_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "doc_id")
    return hits.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < fixed.CONTENT_ROWS).select("query_id", "doc_id", "rank")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    lists = {"words": (_word_list(spark, d), 1.0), "meaning": (vec_votes(spark, d).select("query_id", "doc_id", "rank"), fixed.MEANING_WEIGHT)}
    return fusion.fuse(lists, ["query_id"]).withColumn("fused", F.round("fused", 9))


def filter_boost(spark: SparkSession, d: str) -> DataFrame:
    p = planner.plan_query(LINE, NOW)
    met = fusion.satisfied(F.col("path"), F.col("mtime"), list(p.extensions), "\\projects\\", p.after, p.before)
    return document_files(spark, d).select("doc_id", met.alias("satisfied"), F.round(met * fixed.FILTER_BOOST, 9).alias("boost"))


def plan_query(spark: SparkSession, d: str) -> DataFrame:
    rows = [(p.original, p.text, list(p.extensions), p.folder, p.after, p.before) for p in (planner.plan_query(q, NOW) for q in QUESTIONS)]
    return spark.createDataFrame(rows, "question string, text string, extensions array<string>, folder string, after timestamp, before timestamp")


def worth_asking(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.worth_asking(F.col("file_name"), F.lit(False)).alias("worth"))


def search_lists(spark: SparkSession, d: str, line: str = LINE, now: datetime = NOW, meaning_query: int | None = 1) -> tuple[DataFrame, planner.QueryPlan, DataFrame]:
    """The fused list of one search line, its plan and the files; a layer that is not there is left out."""
    p = planner.plan_query(line, now)
    files = document_files(spark, d)
    needle = p.text.lower()
    hits = files.select("doc_id", names.name_relevance(F.col("name"), needle).alias("r")).filter("r > 0")
    lists = {"name": (fulltext.ranked(hits, [F.desc(F.round("r", 9)), F.asc("doc_id")], fixed.NAME_ROWS), 1.0)}
    wanted = fulltext.phrases(spark, p.text)
    scored = fulltext.scored(*fulltext.prepared(table(spark, d, "documents"), wanted), wanted).withColumn("chunk_id", F.col("doc_id"))
    words = fulltext.documents(scored, table(spark, d, "doc")).withColumn("score", F.round("score", 9))
    lists["words"] = (fulltext.ranked(words, [F.asc("score"), F.asc("doc_id")], fixed.CONTENT_ROWS), 1.0)
    if meaning_query is not None:
        near = table(spark, d, "neighbor").filter(F.col("query_id") == meaning_query)
        votes = fusion.meaning_votes(near, table(spark, d, "chunk"), table(spark, d, "doc"), ["query_id"], 0.5)
        lists["meaning"] = (votes.select("doc_id", "rank"), fixed.MEANING_WEIGHT)
    return fusion.fuse({n: (df.select("doc_id", "rank"), w) for n, (df, w) in lists.items()}, []), p, files


def _searched(spark: SparkSession, d: str, meaning_query: int | None) -> DataFrame:
    fused, p, files = search_lists(spark, d, meaning_query=meaning_query)
    met = fusion.satisfied(F.col("path"), F.col("mtime"), list(p.extensions), p.folder, p.after, p.before)
    out = fused.join(files, "doc_id").withColumn("fused", F.round(fusion.boosted(F.col("fused"), met), 9))
    flags = [c for c in fused.columns if c.startswith("in_")]
    return out.select("doc_id", "name", "path", "fused", *flags).orderBy(F.desc("fused"), "doc_id").limit(fixed.RESULT_ROWS)


def search_e2e(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d, 1)


def search_names_only(spark: SparkSession, d: str) -> DataFrame:
    """A search without the meaning layer."""
    return _searched(spark, d, None)


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k"))).alias("message"))


_ALL = (
    name_search, name_relevance, name_topk, ext_kind, rank_penalty, anon_path, tidy_text, fold_text, tokenize_docs, postings, fts_and, fts_phrase, fts_stems, fts_count, fts_bm25, fts_documents,
    chunk_doc_join, chunk_stats, chunk_dup_stats, token_estimate, token_histogram, embed_guard, embed_order, embed_resume, embed_dedup, vec_votes, rrf_fusion, filter_boost, plan_query, worth_asking,
    search_e2e, search_names_only, json_fields)
QUERIES = {f.__name__: f for f in _ALL}


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_SRC, _DST = text.fold_map()
_SRC = _SRC.removesuffix(text.marks())
_MARKS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in fixed.MARK_BLOCKS) + "]"
_EXT = "lower(regexp_extract(file_name, '(?s)\\.([^.]+)$', 1))"
_KIND = "case " + " ".join(f"when ext in ({_quoted(v.split())}) then {fixed.KIND_IDS[k]}" for k, v in fixed.EXTENSIONS.items()) + " else 0 end"
_FOLD = f"regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(text, '{_MARKS}', '', 'g'), '{_SRC}', '{_DST}'), '[ßẞ]', 'ss', 'g'), '[æÆ]', 'ae', 'g'), '[þÞ]', 'th', 'g')"
_FOLD = _FOLD.replace("[ßẞ]", "[ß]")
_TOKENS = f"list_filter(regexp_extract_all({_FOLD}, '{fixed.TOKEN}+'), lambda x: x <> '')"
_RELEVANCE = f"""round(1 + case when length(name) = {len(NEEDLE)} then 6 when instr(lower(name), '{NEEDLE}') = 1 then 4
  when substr(name, instr(lower(name), '{NEEDLE}') - 1, 1) in (' ', '-', '_', '.') then 2.5 else 0 end + 3.0e0 * {len(NEEDLE)} / length(name) - 0.004e0 * length(name), 9)"""
_FILES = """files as (
  select doc_id, file_name as name, 'c:\\' || replace(coalesce(source, ''), '/', '\\') || '\\' || coalesce(file_name, '') as path,
         case when mtime > 0 then make_timestamp((mtime - 116444736000000000) // 10) end as mtime, rank_penalty
  from documents left join (select doc_id, mtime, rank_penalty from doc) t using (doc_id))"""
_POST = f"""toks as (select doc_id, coalesce({_TOKENS}, []) as t from documents),
sizes as (select doc_id, len(t) as dl from toks),
post as (select doc_id, unnest(t) as term, unnest(range(len(t))) as pos from toks)"""
_VOTES = """near as (select {by} chunk_id, max(score) as score from neighbor where score is not null and {where} group by all),
n1 as (select *, row_number() over ({part} order by score desc, chunk_id) as n from near),
n2 as (select n1.*, doc_id from n1 join chunk using (chunk_id) left join doc using (doc_id) where n <= 60 and score >= 0.5 and coalesce(rank_penalty, 0) <= 0),
n3 as (select *, row_number() over (partition by {by} doc_id order by score desc, chunk_id) as m from n2),
votes as (select {by} doc_id, chunk_id, rank from (select *, row_number() over ({part} order by score desc, chunk_id) - 1 as rank from n3 where m = 1) t where rank < 20)"""
_ALL_VOTES = _VOTES.format(by="query_id,", where="true", part="partition by query_id")
_CHUNKS = """ct as (select chunk_id, substr(hex(text), 2 * boff + 1, 2 * blen) as h from chunk join documents using (doc_id) where boff >= 0 and blen > 0 and text is not null)"""
_BM = f"""with {_POST},
hit as (select doc_id, 0 as phrase, count(*) as tf from post where term = 'contract' group by doc_id
  union all select a.doc_id, 1, count(*) from post a join post b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'every' and b.term = 'shared' group by a.doc_id),
freq as (select phrase, count(*) as n from hit group by phrase),
both_ as (select doc_id from hit group by doc_id having count(*) = 2)"""
_E2E = f"""with {_FILES}, {_POST},
nm as (select doc_id, {_RELEVANCE} as r from files where contains(lower(name), '{NEEDLE}')),
names as (select doc_id, row_number() over (order by r desc, doc_id) - 1 as rank from nm order by rank limit 200),
hit as (select doc_id, count(*) as tf from post where term = '{NEEDLE}' group by doc_id),
c as (select count(*) as total, avg(dl) as avgdl from sizes),
sc as (select doc_id, -greatest(1e-6, ln((total - n + 0.5e0) / (n + 0.5e0))) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)) as score
  from hit join sizes using (doc_id), c, (select count(*) as n from hit) f),
wd as (select doc_id, round(score + coalesce(rank_penalty, 0) - 0.6e0 * ln(2), 9) as score from sc left join doc using (doc_id)),
words as (select doc_id, row_number() over (order by score, doc_id) - 1 as rank from wd order by rank limit 60),
{_VOTES.format(by="", where="query_id = 1", part="")},
lists as (select doc_id, 1e0 / (60 + rank) as v, 'name' as list from names union all select doc_id, 1e0 / (60 + rank), 'words' from words@MEANING@),
fused as (select doc_id, sum(v) as fused, bool_or(list = 'name') as in_name, bool_or(list = 'words') as in_words, bool_or(list = 'meaning') as in_meaning from lists group by doc_id)
select doc_id, name, path, round(fused + 0.25e0 / 60 * (case when path like '%.pdf' or path like '%.PDF' then 1 else 0 end
    + case when mtime >= timestamp '2025-01-01' and mtime < timestamp '2026-01-01' then 1 else 0 end), 9) as fused, in_name, in_words@FLAG@
from fused join files using (doc_id) order by fused desc, doc_id limit 200"""
_B = "[ \\t\\x0b\\f\\xa0]"

SQL = {
    "name_search": f"select doc_id, file_name from documents where contains(lower(file_name), '{NEEDLE}')",
    "name_relevance": f"select doc_id, name as file_name, {_RELEVANCE} as relevance from (select doc_id, file_name as name from documents) t where contains(lower(name), '{NEEDLE}')",
    "name_topk": f"select doc_id, name as file_name, {_RELEVANCE} as relevance from (select doc_id, file_name as name from documents) t where contains(lower(name), '{NEEDLE}') order by relevance desc, doc_id limit 200",
    "ext_kind": f"select doc_id, ext, {_KIND} as kind_by_name, {_KIND} between 4 and 9 as needs_extractor from (select doc_id, {_EXT} as ext from documents) t",
    "rank_penalty": f"""with {_FILES} select doc_id, case when {' or '.join(f"contains(p, '{m}')" for m in fixed.PENALTY_MARKERS)} or {' or '.join(f"ends_with(p, '{m}')" for m in fixed.PENALTY_ENDINGS)}
  then 4.0 else 0.0 end::double as penalty from (select doc_id, lower(left(path, 511)) as p from files) t""",
    "anon_path": f"with {_FILES} select doc_id, case when starts_with(lower(path), 'c:\\projects\\') then 'c:\\~' || substr(path, 12) else path end as shown from files",
    "tidy_text": f"""select doc_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0e-\\x1f\\r\\x{{FEFF}}]', '', 'g'),
  '{_B}*\\n{_B}*\\n[ \\t\\x0b\\f\\xa0\\n]*', chr(1), 'g'), '{_B}*\\n{_B}*', chr(10), 'g'), '{_B}+', ' ', 'g'), '^[ \\n\\x01]+|[ \\n\\x01]+$', '', 'g'), chr(1), chr(10) || chr(10)) as tidy from documents""",
    "fold_text": f"select doc_id, {_FOLD} as folded from documents",
    "tokenize_docs": f"select doc_id, coalesce(len(t), 0) as n_tokens, t[1] as first_token from (select doc_id, {_TOKENS} as t from documents) s",
    "postings": f"with {_POST} select term, count(distinct doc_id) as df, count(*) as cf, sum(pos) as positions from post group by term",
    "fts_and": f"with {_POST} select doc_id from post where term in ('contract', 'garden') group by doc_id having count(distinct term) = 2",
    "fts_count": f"with {_POST} select count(*) as n from (select doc_id from post where term in ('contract', 'garden') group by doc_id having count(distinct term) = 2) t",
    "fts_phrase": f"{_BM} select doc_id, phrase, tf from hit where doc_id in (select doc_id from both_)",
    "fts_bm25": f"""{_BM} select doc_id, round(-sum(greatest(1e-6, ln((total - n + 0.5e0) / (n + 0.5e0))) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 9) as score
  from hit join sizes using (doc_id) join freq using (phrase), (select count(*) as total, avg(dl) as avgdl from sizes) c where doc_id in (select doc_id from both_) group by doc_id""",
    "fts_documents": """select doc_id, round(min(score) + coalesce(max(rank_penalty), 0) - 0.6e0 * ln(1 + least(8, count(*))), 9) as score, least(8, count(*)) as passages, arg_min(best_chunk_id, (score, best_chunk_id)) as best_chunk_id
  from (select distinct best_chunk_id, doc_id, score from content_hit where query_id = 1 and score is not null) t left join doc using (doc_id) group by doc_id order by 2, 1 limit 60""",
    "chunk_doc_join": "select chunk_id, doc_id, volume_id, frn, boff, blen from chunk join (select doc_id, volume_id, frn from doc) t using (doc_id)",
    "chunk_stats": "select kind, count(distinct d.doc_id) as docs, count(distinct c.doc_id) as chunked, count(c.chunk_id) as chunks from doc d left join chunk c using (doc_id) group by kind",
    "chunk_dup_stats": f"with {_CHUNKS} select count(*) as total, count(distinct h) as distinct_chunks from ct",
    "token_estimate": """select doc_id, s * 4 + l * 5 + g * 12 + (a - s - l - g) * 12 + two * 16 + three * 20 + four * 24 as units from (
  select doc_id, length(regexp_replace(text, '[^ \\t\\n\\r\\f\\x0b]', '', 'g')) as s, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as l, length(regexp_replace(text, '[^0-9]', '', 'g')) as g,
    length(regexp_replace(text, '[^\\x00-\\x7f]', '', 'g')) as a, length(regexp_replace(text, '[^\\x{80}-\\x{7FF}]', '', 'g')) as two,
    length(regexp_replace(text, '[^\\x{800}-\\x{FFFF}]', '', 'g')) as three, length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) as four from documents) t""",
    "embed_guard": """select doc_id, not regexp_matches(text, '[A-Za-z0-9\\x{80}-\\x{10FFFF}]{1000}[A-Za-z0-9\\x{80}-\\x{10FFFF}]{25}|[ \\t\\n\\r\\f\\x0b]{257}|[^A-Za-z0-9 \\t\\n\\r\\f\\x0b\\x{80}-\\x{10FFFF}]{257}') as fit from documents""",
    "embed_order": "select doc_id, case when coalesce(rank_penalty, 0) > 0 then 3 when kind between 4 and 9 then 0 when kind = 2 then 2 else 1 end as pass from doc",
    "embed_resume": """select doc_id, n, done from doc join (select doc_id, count(*) as n, count(v.chunk_id) as done from chunk left join (select distinct chunk_id from chunk_vector where len(vec) > 0) v using (chunk_id) group by doc_id) t using (doc_id)
  where n = chunk_count and done < n""",
    "embed_dedup": f"with {_CHUNKS} select chunk_id, min(chunk_id) over (partition by h) as source_id from ct",
    "vec_votes": f"with {_ALL_VOTES} select query_id, doc_id, chunk_id, rank from votes",
    "rrf_fusion": f"""with {_ALL_VOTES},
w as (select query_id, doc_id, row_number() over (partition by query_id order by score, doc_id) - 1 as rank from (select query_id, doc_id, min(score) as score from content_hit where score is not null group by all) t),
l as (select query_id, doc_id, 1e0 / (60 + rank) as v, 'words' as list from w where rank < 60 union all select query_id, doc_id, 0.5e0 / (60 + rank), 'meaning' from votes)
select query_id, doc_id, round(sum(v), 9) as fused, bool_or(list = 'words') as in_words, bool_or(list = 'meaning') as in_meaning from l group by query_id, doc_id""",
    "filter_boost": f"""with {_FILES}, s as (select doc_id, case when lower(path) like '%.pdf' then 1 else 0 end + case when contains(lower(path), '\\projects\\') then 1 else 0 end
    + case when mtime >= timestamp '2025-01-01' and mtime < timestamp '2026-01-01' then 1 else 0 end as satisfied from files) select doc_id, satisfied, round(satisfied * 0.25e0 / 60, 9) as boost from s""",
    "worth_asking": "select doc_id, length(file_name) - length(replace(file_name, ' ', '')) >= 2 and length(file_name) <= 200 as worth from documents",
    "search_e2e": _E2E.replace("@MEANING@", " union all select doc_id, 0.5e0 / (60 + rank), 'meaning' from votes").replace("@FLAG@", ", in_meaning"),
    "search_names_only": _E2E.replace("@MEANING@", "").replace("@FLAG@", ""),
    "json_fields": """select event_id, (props->>'k')::int as k, '{"type":"' || event_type || '","k":' || (props->>'k') || '}' as message from events""",
}
SQL["token_histogram"] = f"""select case when n <= 64 then '1-64' when n <= 128 then '65-128' when n <= 256 then '129-256' when n <= 512 then '257-512' else '513+' end as bucket, count(*) as docs
  from (select ceil(units / 16) as n from ({SQL['token_estimate']}) u where units is not null) t group by 1"""
