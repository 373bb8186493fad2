"""The problems on texts and vectors as queries over the test tables, with SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import packing, pieces, quality, ranking, similar, survivors, tokens
from siltstone.session import materialize, table


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "candidate"), table(spark, d, "file_fact"), table(spark, d, "collector_trust"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d).select("group_slot", "keep_slot")


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d)


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.combined_ranking(*(table(spark, d, t) for t in ("content_hit", "neighbor", "chunk", "doc")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top(_ranking(spark, d), 3).select("query_id", "doc_id")


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    limit = pieces.piece_limit(table(spark, d, "size_limit"))
    return pieces.judge_pieces(table(spark, d, "chunk"), table(spark, d, "documents"), limit).filter("not sound").select("chunk_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_texts(table(spark, d, "documents"), pieces.piece_limit(table(spark, d, "size_limit")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.pairs(similar.similar(table(spark, d, "chunk_vector"), table(spark, d, "vector_header"), k=5, least=0.90))


def p7_search(spark: SparkSession, d: str) -> DataFrame:
    """The queries are the vectors whose id is divisible by 50."""
    asked = F.col("chunk_id") % 50 == 0
    found = similar.similar(table(spark, d, "chunk_vector"), table(spark, d, "vector_header"), k=5, asked=asked)
    return found.select("store_id", "chunk_id", "other_id", "rank")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), tokens.vocabulary_path())


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    path = tokens.vocabulary_path()
    return tokens.decode(tokens.encode(table(spark, d, "documents"), path), path)


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_spans(table(spark, d, "documents"), tokens.vocabulary_path())


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), table(spark, d, "size_limit"), tokens.vocabulary_path())


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rates(p9_containers(spark, d))


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return quality.shapes(docs, quality.fit(table(spark, d, "text_label"), docs, table(spark, d, "common_word")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(_shapes(spark, d))


def p10_shapes(spark: SparkSession, d: str) -> DataFrame:
    return _shapes(spark, d).select("doc_id", *quality.SHAPES)


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"), table(spark, d, "common_word"))


_ALL = (p2_found, p2_records, p3_found, p3_ranking, p4_found, p4_pieces, p7_found, p7_search, p8_ids, p8_decoded, p8_spans, p9_containers, p9_fill, p10_found, p10_shapes, p10_statistics)
QUERIES = {f.__name__: f for f in _ALL}

_NOTHING = ", ".join(f"'{w}'" for w in survivors.PLACEHOLDERS)
_P2 = f"""
with c as (
  select *, regexp_replace(regexp_replace(lower(print), '\\s+', '', 'g'), '^0x|[{{}}()\\-:]', '', 'g') as fp from candidate where ok),
files as (select size, fp, volume_id, frn, min(slot) as slot from c where regexp_full_match(fp, '[0-9a-f]{{32}}') and size is not null group by all),
sets as (select size, fp, min(slot) as group_slot, count(*) as members from files group by all having count(*) > 1),
f as (
  select slot, fact_id, coalesce(trust, -1) as trust, seen_at,
         case when mtime > 0 and mtime <= epoch_us(seen_at) * 10 + 116444736000000000 then mtime end as mtime,
         case when lower(trim(owner)) not in ({_NOTHING}) then trim(owner) end as owner,
         case when lower(trim(title)) not in ({_NOTHING}) then trim(title) end as title
  from file_fact left join collector_trust using (collector)),
best as (
  select slot, arg_max(mtime, (trust, seen_at, fact_id)) filter (mtime is not null) as mtime,
         arg_max(owner, (trust, seen_at, fact_id)) filter (owner is not null) as owner,
         arg_max(title, (trust, seen_at, fact_id)) filter (title is not null) as title
  from f group by slot),
ranked as (
  select group_slot, slot as keep_slot, members, mtime, owner, title,
         row_number() over (partition by size, fp order by (mtime is not null)::int + (owner is not null)::int + (title is not null)::int desc,
                            coalesce(mtime, -1) desc, slot) as nth
  from files join sets using (size, fp) left join best using (slot))
"""
_P3 = """
with w as (select query_id, doc_id, -min(score) as x from content_hit group by all),
m as (select query_id, doc_id, max(n.score)::double as x from neighbor n join chunk using (chunk_id) group by all),
lists as (select *, 'w' as signal from w union all select *, 'm' from m),
s as (select * from lists union all
      select b.query_id, b.doc_id, -coalesce(rank_penalty, 0), 'p' from (select distinct query_id, doc_id from lists) b left join doc using (doc_id)),
a as (select *, abs(x - median(x) over (partition by query_id, signal)) as off, median(x) over (partition by query_id, signal) as med from s),
b as (select *, median(off) over (partition by query_id, signal) as mad, avg(off) over (partition by query_id, signal) as mean from a),
z as (select query_id, doc_id, case when x is null or (signal = 'p' and x < 0) then -4.0
        when mad > 0 then greatest(-4, least(4, (x - med) / (mad * 1.4826)))
        when mean > 0 then greatest(-4, least(4, (x - med) / (mean * 1.2533))) else 0 end as z from b),
r as (select query_id, doc_id, exp((sum(ln(1 / (1 + exp(-z)))) + (3 - count(*)) * ln(1 / (1 + exp(4.0)))) / 3) as score from z group by all)
"""
_P4 = """
with d as (select doc_id, hex(text) as h, strlen(text) as l from documents where text <> ''),
o as (
  select c.*, h, l, boff + greatest(blen, 0) as e, lag(boff) over w as pb, lag(blen) over w as pn, row_number() over w as nth, lead(c.chunk_id) over w is null as final
  from chunk c left join d using (doc_id) window w as (partition by doc_id order by boff, c.chunk_id)),
x as (select *, least(pb + pn, l) - least(256, greatest(pn, 0) // 4) as seam from o),
y as (
  select *, case when substr(h, 2 * seam + 1, 1) not in ('8', '9', 'A', 'B') then seam
                 when substr(h, 2 * seam - 1, 1) not in ('8', '9', 'A', 'B') then seam - 1
                 when substr(h, 2 * seam - 3, 1) not in ('8', '9', 'A', 'B') then seam - 2 else seam - 3 end as start from x),
z as (
  select *, substr(h, 2 * boff + 1, 4100) as s,
         e = l or (substr(h, 2 * e - 1, 2) in ('0A', '20')) or (substr(h, 2 * e - 1, 2) in ('2E', '21', '3F', '3B') and substr(h, 2 * e + 1, 2) in ('0A', '20')) as nat
  from y),
place as (
  select distinct chunk_id from (select chunk_id, boff, l, s, unnest(range(1229, least(2048, l - boff) + 1)) as p from z where boff >= 0 and boff < l and not nat)
  where boff + p = l or substr(s, 2 * p - 1, 2) in ('0A', '20') or (substr(s, 2 * p - 1, 2) in ('2E', '21', '3F', '3B') and substr(s, 2 * p + 1, 2) in ('0A', '20')))
select chunk_id from z where not coalesce(
  blen between 1 and 2048 and boff >= 0 and e <= l
  and substr(h, 2 * boff + 1, 1) not in ('8', '9', 'A', 'B') and substr(h, 2 * e + 1, 1) not in ('8', '9', 'A', 'B')
  and boff = case when nth = 1 then 0 else start end
  and (e = l or (not final and (nat or chunk_id not in (select chunk_id from place)))), false)
"""
_P7 = """
with v as (
  select distinct store_id, chunk_id, vec::double[] as x from chunk_vector join vector_header using (store_id)
  where len(vec) = dimensions and list_sum(list_transform(vec, lambda e: abs(e::int))) > 0),
near as (
  select p.store_id, p.chunk_id as a, q.chunk_id as b, list_dot_product(p.x, q.x) / sqrt(list_dot_product(p.x, p.x) * list_dot_product(q.x, q.x)) as cos,
         row_number() over (partition by p.store_id, p.chunk_id order by round(cos, 12) desc, q.chunk_id) as nth
  from v p join v q on p.store_id = q.store_id and p.chunk_id <> q.chunk_id)
"""
_BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_P10 = rf"""
with w as (select doc_id, count(*) as n_words, sum(length(w)) as letters, count(*) filter (w in (select lower(word) from common_word)) as common
  from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+')) as w from documents) t
  where regexp_matches(w, '[\p{{L}}\p{{M}}]') group by doc_id),
l as (select doc_id, count(*) as n_lines, count(*) filter (regexp_matches(line, '[.!?…:;。！？]["''»”’)\]]?{_BLANK}*$')) as well
  from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) t
  where regexp_replace(line, '{_BLANK}+', '', 'g') <> '' group by doc_id),
s as (select doc_id, length(regexp_replace(text, '{_BLANK}+', '', 'g')) as filled,
        length(regexp_replace(text, '({_BLANK}|[\p{{L}}\p{{M}}\p{{N}}])+', '', 'g')) as symbols from documents)
select d.doc_id, coalesce(n_words, 0) as n_words, letters / n_words as mean_word_length, case when filled > 0 then symbols / filled end as symbol_ratio,
       well / n_lines as punctuated_lines, common / n_words as common_words
from documents d left join w using (doc_id) left join l using (doc_id) left join s using (doc_id)
"""

SQL = {
    "p2_found": f"{_P2} select group_slot, keep_slot from ranked where nth = 1",
    "p2_records": f"{_P2} select group_slot, keep_slot, members, mtime, owner, title from ranked where nth = 1",
    "p3_found": f"{_P3} select query_id, doc_id from (select *, row_number() over (partition by query_id order by score desc, doc_id) as n from r) where n <= 3",
    "p4_found": _P4,
    "p7_found": f"{_P7} select distinct least(a, b) as chunk_a, greatest(a, b) as chunk_b from near where nth <= 5 and cos >= 0.90",
    "p7_search": f"{_P7} select store_id, a as chunk_id, b as other_id, nth as rank from near where nth <= 5 and a % 50 = 0",
    "p10_statistics": _P10,
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
