"""The file table, space, vectors and the life of the index as queries over the test tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import fixed, names
from siltstone.operators import index_store, space, vectors
from siltstone.operators.changes import change_effects, current_table, volume_counts
from siltstone.operators.hierarchy import full_paths, hierarchy
from siltstone.plans.core_problems import _P5, _P6, _forest
from siltstone.plans.search import _FILES, document_files
from siltstone.session import materialize, table

FLOOR, BUDGET, BIGGEST, TOP = 1 << 20, 2000, 4000, 10
TREES = [("data", None, 1), *fixed.GENERATED]
AREAS = ["documents", "downloads", "pictures", "work", "appdata"]
BUILT_AT = "2024-01-02 00:00:00"


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The current table, and its hierarchy with paths."""
    nodes, roots = _forest(spark, d)
    nodes = materialize(nodes, "nodes")
    return nodes, full_paths(hierarchy(nodes, roots), table(spark, d, "snapshot_header"))


def full_path(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d)[1].filter("fault is null").select("volume_id", "frn", "path")


def child_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = _forest(spark, d)
    kids = nodes.filter("frn <> parent_frn").groupBy("volume_id", F.col("parent_frn").alias("frn")).agg(F.count("*").alias("children"))
    return nodes.select("volume_id", "frn").join(kids, ["volume_id", "frn"], "left").na.fill(0, ["children"])


def compact_tree(spark: SparkSession, d: str) -> DataFrame:
    """The living files, a parent that lives no more being none."""
    nodes = materialize(_forest(spark, d)[0], "nodes")
    there = nodes.select("volume_id", F.col("frn").alias("parent_frn"), F.lit(True).alias("lives"))
    j = nodes.join(there, ["volume_id", "parent_frn"], "left")
    return j.select("volume_id", "frn", F.when(F.col("lives"), F.col("parent_frn")).alias("parent_frn"), "name")


def frn_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For every reference in the journal: whether that very file lives, and whether its record number is used by another."""
    nodes = materialize(_forest(spark, d)[0].select("volume_id", "frn"), "nodes")
    asked = table(spark, d, "journal_entry").select("volume_id", "frn").dropna().distinct()
    number = F.col("frn").bitwiseAND(F.lit((1 << 48) - 1))
    records = nodes.groupBy("volume_id", number.alias("record")).agg(F.count("*").alias("n"))
    j = asked.withColumn("record", number).join(nodes.withColumn("lives", F.lit(True)), ["volume_id", "frn"], "left").join(records, ["volume_id", "record"], "left")
    lives = F.coalesce("lives", F.lit(False))
    return j.select("volume_id", "frn", lives.alias("lives"), (F.coalesce("n", F.lit(0)) > lives.cast("int")).alias("used_again"))


def select_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Why each file of the current table is read or not."""
    nodes, found = _placed(spark, d)
    p = found.select("volume_id", "frn", "path").join(nodes.select("volume_id", "frn", "name", "attributes"), ["volume_id", "frn"])
    folder = F.coalesce(F.col("attributes"), F.lit(0)).bitwiseAND(F.lit(fixed.DIRECTORY)) != 0
    reason = names.skip_reason(F.lit(False), folder, F.coalesce(names.in_excluded_folder(F.col("path")), F.lit(False)), F.col("name"))
    return p.select("volume_id", "frn", reason.alias("reason"))


def area_breakdown(spark: SparkSession, d: str) -> DataFrame:
    nodes, found = _placed(spark, d)
    p = F.lower("path")
    area = F.lit("elsewhere")
    for a in reversed(AREAS):
        area = F.when(F.contains(p, F.lit(f"\\{a}\\")), a).otherwise(area)
    rows = found.filter("fault is null").select("volume_id", "frn", area.alias("area")).join(nodes.select("volume_id", "frn", "name"), ["volume_id", "frn"])
    return rows.groupBy("area", names.kind_of(F.col("name")).alias("kind")).agg(F.count("*").alias("files"))


def gen_trees(spark: SparkSession, d: str) -> DataFrame:
    nodes, found = _placed(spark, d)
    return space.generated_trees(materialize(found.drop("path"), "found"), nodes, TREES)


def inside_folder(spark: SparkSession, d: str) -> DataFrame:
    return document_files(spark, d).select("doc_id", names.inside_folder(F.col("path"), F.lit("c:\\Projects\\")).alias("inside"))


def gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc").select("doc_id", names.gate(F.lit(0), F.col("size"), F.col("kind")).alias("verdict"))


def gate_stats(spark: SparkSession, d: str) -> DataFrame:
    v = names.gate(F.lit(0), F.col("size"), F.col("kind"))
    return table(spark, d, "doc").groupBy(v.alias("verdict"), "kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def magic_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", names.magic_kind(F.encode("text", "UTF-8"), F.col("kind")).alias("found_kind"))


def reader_gates(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the documents' bytes at the gates, and of what kind their first bytes say they are."""
    raw = table(spark, d, "documents").select("kind", F.encode("text", "UTF-8").alias("raw"))
    verdict = names.gate(F.lit(0), F.octet_length("raw"), F.col("kind"))
    found = F.when(verdict == "open", names.magic_kind(F.col("raw"), F.col("kind")))
    return raw.groupBy(verdict.alias("verdict"), found.alias("found_kind")).agg(F.count("*").alias("files"))


def stored_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(names.needs_extractor(F.col("kind"))).select("doc_id", "text", F.octet_length("text").alias("raw_len"))


def scan_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_fact").groupBy("collector").agg(F.count("*").alias("facts"), F.count_if(F.col("size").isNull()).alias("unreadable"), F.sum("size").alias("bytes"))


def dup_size_groups(spark: SparkSession, d: str) -> DataFrame:
    return space.size_groups(table(spark, d, "candidate"), FLOOR)


def dup_budget(spark: SparkSession, d: str) -> DataFrame:
    return space.within_budget(dup_size_groups(spark, d), BUDGET).select("size", "members", "reclaimable", "files_so_far")


def dup_floors(spark: SparkSession, d: str) -> DataFrame:
    g = space.size_groups(table(spark, d, "candidate"), min(fixed.SIZE_FLOORS))
    floors = F.filter(F.array(*[F.lit(x).cast("bigint") for x in fixed.SIZE_FLOORS]), lambda x: x <= F.col("size"))
    rows = g.select("members", "reclaimable", F.explode(floors).alias("floor"))
    return rows.groupBy("floor").agg(F.count("*").alias("groups"), F.sum("members").alias("files"), F.sum("reclaimable").alias("bytes"))


def dup_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """How many texts share a fingerprint of their edges and size."""
    f = table(spark, d, "documents").filter("text is not null").select(space.edge_fingerprint(F.encode("text", "UTF-8")).alias("edge"))
    return f.groupBy("edge").agg(F.count("*").alias("files")).select("files")


def _exact(spark: SparkSession, d: str) -> DataFrame:
    return space.exact_duplicates(table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw")), "raw", "doc_id")


def dup_exact(spark: SparkSession, d: str) -> DataFrame:
    return _exact(spark, d)


def dup_keeper(spark: SparkSession, d: str) -> DataFrame:
    hashed = table(spark, d, "documents").filter("text <> ''").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))
    members = hashed.join(_exact(spark, d).select("hash"), "hash").join(document_files(spark, d), "doc_id")
    return space.keepers(members, "hash").select("hash", "doc_id")


def dup_funnel(spark: SparkSession, d: str) -> DataFrame:
    """One row: texts considered, sharing a size, sharing their edges too, groups and bytes to gain."""
    raw = F.encode("text", "UTF-8")
    f = table(spark, d, "documents").filter("text <> ''").select(F.octet_length(raw).alias("size"), space.edge_fingerprint(raw).alias("edge"))
    by_edge = f.groupBy("size", "edge").agg(F.count("*").alias("n"))
    by_size = by_edge.groupBy("size").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("alike"))
    counts = by_size.agg(F.sum("n").alias("considered"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("sharing_size"), F.sum("alike").alias("hashed"))
    return counts.crossJoin(_exact(spark, d).agg(F.count("*").alias("groups"), F.sum("reclaimable").alias("reclaimable")))  # one row each


def size_concentration(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "candidate").select(F.col("slot").alias("id"), "size").filter("size is not null")
    return space.concentration(files).withColumn("share", F.round("share", 9))


def space_topn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate").filter("size is not null").select("slot", "size").orderBy(F.desc("size"), "slot").limit(BIGGEST)


def _eights(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", vectors.quantized(vectors.normalized(F.col("embedding"))).alias("q"))


def vec_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform(vectors.normalized(F.col("embedding")), lambda x: F.round(x.cast("double"), 6))
    return table(spark, d, "embeddings").select("vec_id", v.alias("v"))


def vec_quantize(spark: SparkSession, d: str) -> DataFrame:
    return _eights(spark, d).select("vec_id", F.transform("q", lambda x: x.cast("int")).alias("q"))


def _asked(v: DataFrame) -> DataFrame:
    return v.filter(F.col("vec_id") % 50 == 0)


def vec_topk(spark: SparkSession, d: str) -> DataFrame:
    """The queries are the vectors whose id is divisible by 50."""
    v = _eights(spark, d)
    return vectors.top_k(v, _asked(v), TOP).select("query_id", "vec_id", F.round(F.col("dot") / float(vectors.SCALE**2), 9).alias("score"), "rank")


def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    v = _eights(spark, d)
    e = vectors.evaluation(vectors.top_k(v, _asked(v), TOP), v, _asked(v))
    return e.select(F.round("mrr", 9).alias("mrr"), F.round("p5", 9).alias("p5"), "queries")


def vector_identity(spark: SparkSession, d: str) -> DataFrame:
    return index_store.vector_states(table(spark, d, "chunk_vector"), table(spark, d, "vector_header"), table(spark, d, "chunk"))


def _dead(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose newest observation could not be read."""
    scanned = index_store.latest_scan(table(spark, d, "doc_scan")).filter("content_hash_lo is null")
    return table(spark, d, "doc").join(scanned.select("volume_id", "frn"), ["volume_id", "frn"], "left_semi").select("doc_id")


def purge_dead(spark: SparkSession, d: str) -> DataFrame:
    """What is left of documents, chunks and vectors, the vectors being taken out first."""
    dead = materialize(_dead(spark, d), "dead")
    chunk = table(spark, d, "chunk")
    gone = chunk.join(dead, "doc_id", "left_semi").select("chunk_id")
    one = lambda n, df: df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("part"), "rows")
    vec = one("vectors", index_store.without(table(spark, d, "chunk_vector"), gone, "chunk_id"))
    return vec.unionByName(one("chunks", index_store.without(chunk, dead, "doc_id"))).unionByName(one("docs", index_store.without(table(spark, d, "doc"), dead, "doc_id")))


def vector_remove(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "chunk").join(_dead(spark, d), "doc_id", "left_semi").select("chunk_id")
    return index_store.without(table(spark, d, "chunk_vector"), gone, "chunk_id").select("store_id", "chunk_id")


def delete_selective(spark: SparkSession, d: str) -> DataFrame:
    """The documents left when those of markup are deleted, and their chunks."""
    dead = table(spark, d, "doc").filter("kind = 3").select("doc_id")
    left = index_store.without(table(spark, d, "chunk"), dead, "doc_id").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return index_store.without(table(spark, d, "doc"), dead, "doc_id").select("doc_id").join(left, "doc_id", "left").na.fill(0, ["chunks"])


def index_delta(spark: SparkSession, d: str) -> DataFrame:
    return index_store.actions(index_store.latest_scan(table(spark, d, "doc_scan")), table(spark, d, "doc"))


def verify_identity(spark: SparkSession, d: str) -> DataFrame:
    return index_store.verdicts(table(spark, d, "doc"), index_store.latest_scan(table(spark, d, "doc_scan")))


def repenalize(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose penalty by path is another than the stored one."""
    f = document_files(spark, d).withColumn("penalty", names.rank_penalty(F.col("path")))
    return f.filter(F.coalesce("rank_penalty", F.lit(0.0)) != F.col("penalty")).select("doc_id", "rank_penalty", "penalty")


def stale_index(spark: SparkSession, d: str) -> DataFrame:
    """Stores made by an older chunker or for an older generation of the content than the newest store."""
    h = table(spark, d, "vector_header")
    newest = h.agg(F.max("chunker_version").alias("c"), F.max("content_generation").alias("g"))
    return h.crossJoin(F.broadcast(newest)).select("store_id", ((F.col("chunker_version") < F.col("c")) | (F.col("content_generation") < F.col("g"))).alias("stale"))  # one row


def _event_journal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The events as a journal of their users: error deletes, purchase renames, anything else leaves the name."""
    e = table(spark, d, "events")
    name = F.when(F.col("event_type") == "purchase", F.concat(F.lit("p"), F.col("event_id").cast("string"))).otherwise("u")
    j = e.select(
        F.col("event_id").alias("entry_id"), F.lit(1).cast("bigint").alias("volume_id"), F.col("event_id").alias("usn"), F.col("user_id").alias("frn"),
        F.lit(0).cast("bigint").alias("parent_frn"), F.lit(32).alias("attributes"), name.alias("name"), F.when(F.col("event_type") == "error", 512).otherwise(0).cast("bigint").alias("reason"))
    return j, table(spark, d, "snapshot_entry").limit(0), table(spark, d, "snapshot_header").limit(0)


def cdc_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return current_table(*_event_journal(spark, d)).select(F.col("frn").alias("user_id"), "name")


def cdc_counters(spark: SparkSession, d: str) -> DataFrame:
    j, s, h = _event_journal(spark, d)
    return volume_counts(change_effects(j, s, h), h).select("created", "deleted", "updated")


def watch_staleness(spark: SparkSession, d: str) -> DataFrame:
    """Per user, whether anything happened after the index was built."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return e.select("user_id", (F.col("last") > F.to_timestamp_ntz(F.lit(BUILT_AT))).alias("stale"))


_ALL = (
    full_path, child_counts, compact_tree, frn_lookup, select_candidates, area_breakdown, gen_trees, inside_folder, gate_verdict, gate_stats, reader_gates, magic_kind, stored_text, scan_stats,
    dup_size_groups, dup_budget, dup_floors, dup_fingerprint, dup_exact, dup_keeper, dup_funnel, size_concentration, space_topn,
    vec_normalize, vec_quantize, vec_topk, retrieval_eval, vector_identity, vector_remove, purge_dead, delete_selective, index_delta, verify_identity, repenalize, stale_index,
    cdc_latest_state, cdc_counters, watch_staleness)
QUERIES = {f.__name__: f for f in _ALL}


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_TREE = f"with recursive {_P5}, {_P6.rstrip().rstrip(',')}"
_EXT = "lower(regexp_extract(name, '(?s)\\.([^.]+)$', 1))"
_KIND = "case " + " ".join(f"when {_EXT} in ({_quoted(v.split())}) then {fixed.KIND_IDS[k]}" for k, v in fixed.EXTENSIONS.items()) + " else 0 end"
_GATE = f"case when coalesce(size, 0) <= 0 then 'empty' when size > case when kind in (1, 2, 3) then {fixed.TEXT_LIMIT} else {fixed.OTHER_LIMIT} end then 'too_big' else 'open' end"
_SIZES = "g as (select size, count(*) as members, size * (count(*) - 1) as reclaimable from (select distinct volume_id, frn, size from candidate where size >= {floor}) t group by size having count(*) > 1)"
_RAW = "raw as (select doc_id, text, hex(text) as h, strlen(text) as n from documents where text is not null)"
_DUPS = "x as (select sha256(text) as hash, n as size, count(*) as members, min(doc_id) as first_id, n * (count(*) - 1) as reclaimable from raw where n > 0 group by sha256(text), n having count(*) > 1)"
_SCAN = "scan as (select * from (select *, row_number() over (partition by volume_id, frn order by usn desc, extractor_ver desc, scan_id desc) as nth from doc_scan) t where nth = 1)"
_DEAD = f"{_SCAN}, dead as (select doc_id from doc join scan using (volume_id, frn) where scan.content_hash_lo is null)"
_Q = """u as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
nv as (select vec_id, label, list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v)))::float) as v from u),
q as (select vec_id, label, list_transform(v, lambda x: greatest(-127, least(127, trunc(x * 127.0::float + case when x >= 0 then 0.5::float else -0.5::float end)::int))) as q from nv)"""
_TOPK = f"""{_Q},
s as (select a.vec_id as query_id, a.label as want, b.vec_id, b.label, list_dot_product(a.q::double[], b.q::double[]) as dot from q a join q b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by dot desc, vec_id) as rank from s)"""
_CDC = """image as (select user_id, event_id, event_type = 'error' as gone, case when event_type = 'purchase' then 'p' || event_id else 'u' end as name from events),
step as (select *, lag(gone) over w as b_gone, lag(name) over w as b_name, row_number() over (partition by user_id order by event_id desc) as nth from image window w as (partition by user_id order by event_id))"""

SQL = {
    "full_path": f"{_TREE} select volume_id, frn, path from down",
    "child_counts": f"with {_P5} select s.volume_id, s.frn, count(c.frn) as children from state s left join state c on c.volume_id = s.volume_id and c.parent_frn = s.frn and c.frn <> c.parent_frn group by all",
    "compact_tree": f"with {_P5} select s.volume_id, s.frn, p.frn as parent_frn, s.name from state s left join state p on p.volume_id = s.volume_id and p.frn = s.parent_frn",
    "frn_lookup": f"""with {_P5}, rec as (select volume_id, frn & 281474976710655 as record, count(*) as n from state group by all)
select a.volume_id, a.frn, s.frn is not null as lives, coalesce(n, 0) > (s.frn is not null)::int as used_again
from (select distinct volume_id, frn from journal_entry where volume_id is not null and frn is not null) a left join state s using (volume_id, frn)
left join rec r on r.volume_id = a.volume_id and r.record = a.frn & 281474976710655""",
    "select_candidates": f"""{_TREE}
select s.volume_id, s.frn, case when coalesce(attributes, 0) & 16 <> 0 then 'directory' when coalesce(list_has_any(string_split(lower(path), '\\')[:-2], [{_quoted(fixed.EXCLUDED_FOLDERS)}]), false) then 'excluded'
  when coalesce({_EXT}, '') = '' then 'no_extension' when {_KIND} = 0 then 'unknown_extension' else 'candidate' end as reason from state s left join down d using (volume_id, frn)""",
    "area_breakdown": f"{_TREE} select case {' '.join(f'''when contains(lower(path), '{chr(92)}{a}{chr(92)}') then '{a}' ''' for a in AREAS)} else 'elsewhere' end as area, {_KIND} as kind, count(*) as files from down join state using (volume_id, frn) group by 1, 2",
    "gen_trees": f"""{_TREE},
f as (select d.volume_id, d.frn, d.up, lower(s.name) as name, lower(p.name) as above, coalesce(s.attributes, 0) as a from down d join state s using (volume_id, frn)
  left join state p on p.volume_id = s.volume_id and p.frn = s.parent_frn where d.depth > 0),
m as (select * from f where a & 16 <> 0 and a & 1024 = 0 and ({' or '.join(f"(name = '{n}'" + (f" and above = '{u}'" if u else '') + ')' for n, u, _ in TREES)})),
o as (select * from m where not exists (select 1 from m x where x.volume_id = m.volume_id and x.frn <> m.frn and list_contains(m.up, x.frn)))
select o.volume_id, o.frn, count(*) as files from o join f on f.volume_id = o.volume_id and list_contains(f.up, o.frn) and f.frn <> o.frn where f.a & 16 = 0 group by all""",
    "inside_folder": f"with {_FILES} select doc_id, starts_with(lower(path), 'c:\\projects\\') and length(path) > 12 as inside from files",
    "gate_verdict": f"select doc_id, {_GATE} as verdict from doc",
    "gate_stats": f"select {_GATE} as verdict, kind, count(*) as files, sum(size) as bytes from doc group by 1, 2",
    "reader_gates": f"""with m as (select case when coalesce(n, 0) = 0 then 'empty' when n > case when kind in (1, 2, 3) then {fixed.TEXT_LIMIT} else {fixed.OTHER_LIMIT} end then 'too_big' else 'open' end as verdict,
  case when n < 4 then kind {' '.join(f"when starts_with(h, '{m}') then {fixed.KIND_IDS[k]}" for k, m in fixed.MAGIC.items())}
  when {' or '.join(f"starts_with(h, '{m}')" for m in fixed.ZIP_MAGIC)} then case when kind in (5, 7, 9) then kind else 0 end when {' or '.join(f"starts_with(h, '{m}')" for m in fixed.BINARY_MAGIC)} then 0 else kind end as k
  from (select kind, hex(text) as h, strlen(text) as n from documents) t) select verdict, case when verdict = 'open' then k end as found_kind, count(*) as files from m group by 1, 2""",
    "magic_kind": f"""select doc_id, case when n = 0 then 0 when n < 4 then kind {' '.join(f"when starts_with(h, '{m}') then {fixed.KIND_IDS[k]}" for k, m in fixed.MAGIC.items())}
  when {' or '.join(f"starts_with(h, '{m}')" for m in fixed.ZIP_MAGIC)} then case when kind in (5, 7, 9) then kind else 0 end when {' or '.join(f"starts_with(h, '{m}')" for m in fixed.BINARY_MAGIC)} then 0 else kind end as found_kind
  from (select doc_id, kind, hex(text) as h, strlen(text) as n from documents) t""",
    "stored_text": "select doc_id, text, strlen(text) as raw_len from documents where kind between 4 and 9",
    "scan_stats": "select collector, count(*) as facts, count(*) filter (size is null) as unreadable, sum(size) as bytes from file_fact group by collector",
    "dup_size_groups": f"with {_SIZES.format(floor=FLOOR)} select * from g",
    "dup_budget": f"with {_SIZES.format(floor=FLOOR)} select * from (select *, sum(members) over (order by reclaimable desc, size desc rows unbounded preceding) as files_so_far from g) t where files_so_far <= {BUDGET}",
    "dup_floors": f"with {_SIZES.format(floor=min(fixed.SIZE_FLOORS))} select floor, count(*) as groups, sum(members) as files, sum(reclaimable) as bytes from g join (select unnest({fixed.SIZE_FLOORS}) as floor) f on size >= floor group by floor",
    "dup_fingerprint": f"with {_RAW}, e as (select left(h, {2 * fixed.EDGE_BYTES}) || right(h, 2 * least(greatest(n - {fixed.EDGE_BYTES}, 0), {fixed.EDGE_BYTES})::int) || n as k from raw) select count(*) as files from e group by k",
    "dup_exact": f"with {_RAW}, {_DUPS} select * from x",
    "dup_keeper": f"""with {_FILES}, {_RAW}, {_DUPS},
k as (select x.hash, f.doc_id, row_number() over (partition by x.hash order by {' or '.join(f"contains(lower(path), '{m}')" for m in fixed.BUILT)}, {' or '.join(f"contains(lower(path), '{m}')" for m in fixed.TRANSIT)},
  length(path) - length(replace(path, '\\', '')), coalesce(mtime, timestamp '1601-01-01'), f.doc_id) as nth from x join raw on sha256(raw.text) = x.hash join files f using (doc_id))
select hash, doc_id from k where nth = 1""",
    "dup_funnel": f"""with {_RAW}, {_DUPS}, e as (select n, left(h, {2 * fixed.EDGE_BYTES}) || right(h, 2 * least(greatest(n - {fixed.EDGE_BYTES}, 0), {fixed.EDGE_BYTES})::int) || n as k from raw where n > 0),
c as (select count(*) over (partition by n) as a, count(*) over (partition by k) as b from e)
select (select count(*) from c) as considered, (select count(*) from c where a > 1) as sharing_size, (select count(*) from c where b > 1) as hashed, (select count(*) from x) as groups, (select sum(reclaimable) from x) as reclaimable""",
    "size_concentration": f"""with r as (select size, row_number() over (order by size desc, slot) as n from candidate where size is not null)
select t as top, sum(size) filter (n <= t) as bytes, round(sum(size) filter (n <= t) / (select sum(size) from r), 9) as share from r, (select unnest({fixed.CONCENTRATION}) as t) x group by t""",
    "space_topn": f"select slot, size from candidate where size is not null order by size desc, slot limit {BIGGEST}",
    "vec_normalize": f"with {_Q} select vec_id, list_transform(v, lambda x: round(x::double, 6)) as v from nv",
    "vec_quantize": f"with {_Q} select vec_id, q from q",
    "vec_topk": f"with {_TOPK} select query_id, vec_id, round(dot / 16129.0e0, 9) as score, rank from r where rank <= {TOP}",
    "retrieval_eval": f"""with {_TOPK}, p as (select query_id, min(rank) filter (label = want) as first, count(*) filter (label = want and rank <= 5) as good from r where rank <= {TOP} group by query_id)
select round(avg(coalesce(1.0e0 / first, 0)), 9) as mrr, round(avg(good / 5.0e0), 9) as p5, count(*) as queries from p""",
    "vector_identity": """select store_id, case when dimensions is null then 'unknown_store' when coalesce(len(vec), 0) = 0 then 'empty' when len(vec) <> dimensions then 'wrong_length' when boff is null then 'no_chunk'
  when boff is distinct from byte_offset then 'moved' else 'usable' end as state, count(*) as vectors from chunk_vector left join vector_header using (store_id) left join chunk using (chunk_id) group by 1, 2""",
    "vector_remove": f"with {_DEAD} select store_id, chunk_id from chunk_vector where chunk_id not in (select chunk_id from chunk join dead using (doc_id))",
    "purge_dead": f"""with {_DEAD} select 'vectors' as part, count(*) as rows from chunk_vector where chunk_id not in (select chunk_id from chunk join dead using (doc_id))
union all select 'chunks', count(*) from chunk where doc_id not in (select doc_id from dead) union all select 'docs', count(*) from doc where doc_id not in (select doc_id from dead)""",
    "delete_selective": "select d.doc_id, count(c.chunk_id) as chunks from doc d left join chunk c using (doc_id) where kind <> 3 group by d.doc_id",
    "index_delta": f"""with {_SCAN} select s.volume_id, s.frn, case when coalesce(s.size = d.size and s.mtime = d.mtime and s.extractor_ver = d.extractor_ver and s.mtime > 0, false) then 'skip_metadata'
  when s.content_hash_lo is null or s.content_hash_hi is null then 'unreadable' when d.doc_id is null then 'insert'
  when s.content_hash_lo = d.content_hash_lo and s.content_hash_hi = d.content_hash_hi and s.extractor_ver = d.extractor_ver then 'skip_content' else 'update' end as action
from scan s left join doc d using (volume_id, frn)""",
    "verify_identity": f"""with {_SCAN} select d.doc_id, case when s.scan_id is null then 'missing' when s.content_hash_lo is null then 'locked'
  when s.size is not distinct from d.size and s.mtime is not distinct from d.mtime then 'same' else 'changed' end as verdict from doc d left join scan s using (volume_id, frn)""",
    "repenalize": f"""with {_FILES}, p as (select doc_id, rank_penalty, case when {' or '.join(f"contains(p, '{m}')" for m in fixed.PENALTY_MARKERS)} or {' or '.join(f"ends_with(p, '{m}')" for m in fixed.PENALTY_ENDINGS)}
  then 4.0 else 0.0 end::double as penalty from (select doc_id, rank_penalty, lower(left(path, 511)) as p from files) t) select * from p where coalesce(rank_penalty, 0) <> penalty""",
    "stale_index": "select store_id, chunker_version < max(chunker_version) over () or content_generation < max(content_generation) over () as stale from vector_header",
    "cdc_latest_state": f"with {_CDC} select user_id, name from step where nth = 1 and not gone",
    "cdc_counters": f"""with {_CDC} select count(*) filter (not gone and coalesce(b_gone, true)) as created, count(*) filter (gone and not coalesce(b_gone, true)) as deleted,
  count(*) filter (not gone and not coalesce(b_gone, true) and name is distinct from b_name) as updated from step""",
    "watch_staleness": f"select user_id, max(ts) > timestamp '{BUILT_AT}' as stale from events group by user_id",
}
