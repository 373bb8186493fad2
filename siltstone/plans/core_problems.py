"""The general problems as queries over the test tables, with SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.changes import change_effects, current_table, judge_stats, volume_counts
from siltstone.operators.hierarchy import descendant_counts, descendants, faults, full_paths, hierarchy
from siltstone.operators.incremental import ChangeCapture, replay_runs
from siltstone.session import fresh_path, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    cap = ChangeCapture(spark, fresh_path(spark, "capture"), table(spark, d, "doc"), table(spark, d, "doc_scan"))
    return replay_runs(cap, table(spark, d, "index_run"))


def _journal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "journal_entry"), table(spark, d, "snapshot_entry"), table(spark, d, "snapshot_header")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return change_effects(*_journal(spark, d))


def p5_state(spark: SparkSession, d: str) -> DataFrame:
    return current_table(*_journal(spark, d))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return volume_counts(p5_found(spark, d), table(spark, d, "snapshot_header"))


def p5_stats(spark: SparkSession, d: str) -> DataFrame:
    return judge_stats(table(spark, d, "catchup_stats"), *_journal(spark, d))


def _forest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = table(spark, d, "snapshot_header")
    s = table(spark, d, "snapshot_entry")
    roots = s.join(h.select("volume_id", F.col("root_index").alias("slot")), ["volume_id", "slot"]).select("volume_id", "frn")
    return current_table(*_journal(spark, d)), roots


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return faults(*_forest(spark, d))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    found = descendant_counts(hierarchy(*_forest(spark, d)))
    return full_paths(found, table(spark, d, "snapshot_header")).select("volume_id", "frn", "fault", "depth", "root", "path", "n_descendants")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchy(*_forest(spark, d)))


QUERIES = {f.__name__: f for f in (p1_found, p5_found, p5_state, p5_counts, p5_stats, p6_found, p6_paths, p6_descendants)}

_P5 = """
entry as (
  select volume_id, usn, frn, parent_frn, name, attributes, (coalesce(reason, 0) & 512) <> 0 as gone
  from (select j.*, row_number() over (partition by j.volume_id, j.usn order by j.entry_id) as nth
        from journal_entry j left join snapshot_header h on h.volume_id = j.volume_id
        where h.next_usn is null or j.usn >= h.next_usn) t
  where nth = 1),
image as (
  select volume_id, frn, cast(-1 as bigint) as usn, parent_frn, name, attributes, false as gone from snapshot_entry
  union all select volume_id, frn, usn, parent_frn, name, attributes, gone from entry),
state as (
  select volume_id, frn, parent_frn, name, attributes from (
    select *, row_number() over (partition by volume_id, frn order by usn desc) as nth from image) t
  where nth = 1 and not gone),
step as (
  select *, lag(gone) over w as b_gone, lag(name) over w as b_name, lag(parent_frn) over w as b_parent
  from image window w as (partition by volume_id, frn order by usn)),
effects as (
  select volume_id, usn, case
      when gone and not coalesce(b_gone, true) then 'deleted'
      when not gone and coalesce(b_gone, true) then 'created'
      when not gone and (name is distinct from b_name or parent_frn is distinct from b_parent) then 'updated' end as effect
  from step where usn >= 0)
"""

_P6 = """
root as (select s.volume_id, s.frn from snapshot_entry s join snapshot_header h on h.volume_id = s.volume_id and h.root_index = s.slot),
down as (
  select s.volume_id, s.frn, 0 as depth, h.drive || ':' as path, [s.frn] as up
  from state s join root r using (volume_id, frn) join snapshot_header h using (volume_id)
  union all
  select c.volume_id, c.frn, p.depth + 1, p.path || '\\' || coalesce(c.name, ''), list_append(p.up, c.frn)
  from down p join state c on c.volume_id = p.volume_id and c.parent_frn = p.frn and c.frn <> c.parent_frn),
"""

_P6_FOUND = """
lost as (select s.* from state s left join down d using (volume_id, frn) where d.frn is null),
walk as (
  select volume_id, frn, parent_frn as up_frn, 1 as n, [frn] as seen, false as shut from lost
  union all
  select w.volume_id, w.frn, s.parent_frn, w.n + 1, list_append(w.seen, w.up_frn), list_contains(w.seen, w.up_frn)
  from walk w join state s on s.volume_id = w.volume_id and s.frn = w.up_frn where not w.shut)
select volume_id, frn, case when bool_or(up_frn = frn) then 'cycle' when bool_or(shut) then 'below_cycle' else 'orphan' end as fault
from walk group by volume_id, frn
"""

SQL = {
    "p1_found": """
with run as (select run_id, coalesce(lag(run_id) over (order by run_id), 0) as prev from index_run where status = 'ok'),
record as (
  select volume_id, frn, usn, extractor_ver as v, content_hash_lo as lo, content_hash_hi as hi, 0 as run_id from doc
  union all
  select volume_id, frn, usn, extractor_ver, content_hash_lo, content_hash_hi, run_id from doc_scan
  where content_hash_lo is not null and content_hash_hi is not null),
best as (
  select r.run_id as at, d.volume_id, d.frn, d.v, d.lo, d.hi,
         row_number() over (partition by r.run_id, d.volume_id, d.frn order by d.usn desc, d.v desc, d.lo desc, d.hi desc) as nth
  from (select run_id from run union select 0) r join record d on d.run_id <= r.run_id)
select r.run_id, n.volume_id, n.frn
from run r join best n on n.at = r.run_id and n.nth = 1
left join best o on o.at = r.prev and o.nth = 1 and o.volume_id = n.volume_id and o.frn = n.frn
where o.frn is null or o.v is distinct from n.v or o.lo is distinct from n.lo or o.hi is distinct from n.hi
""",
    "p5_found": f"with {_P5} select volume_id, usn, effect from effects where effect is not null",
    "p5_state": f"with {_P5} select volume_id, frn, parent_frn, name, attributes from state",
    "p5_counts": f"""with {_P5}
select h.volume_id, count(*) filter (effect = 'created') as created, count(*) filter (effect = 'deleted') as deleted,
       count(*) filter (effect = 'updated') as updated
from snapshot_header h left join effects e using (volume_id) group by h.volume_id""",
    "p5_stats": f"""with {_P5},
j as (select distinct volume_id, usn from journal_entry),
r as (select stats_id, count(j.usn) as n from catchup_stats s left join j on j.volume_id = s.volume_id and j.usn >= s.from_usn and j.usn < s.to_usn group by stats_id),
c as (select stats_id, count(*) filter (effect = 'created') as created, count(*) filter (effect = 'deleted') as deleted, count(*) filter (effect = 'updated') as updated
  from catchup_stats s left join effects e on e.volume_id = s.volume_id and e.usn >= s.from_usn and e.usn < s.to_usn group by stats_id)
select stats_id, r.n as records_read, c.created, c.deleted, c.updated,
       coalesce(s.records_read = r.n and s.created = c.created and s.deleted = c.deleted and s.updated = c.updated, false) as agrees
from catchup_stats s join r using (stats_id) join c using (stats_id)""",
    "p6_found": f"with recursive {_P5}, {_P6} {_P6_FOUND}",
    "p6_paths": f"""with recursive {_P5}, {_P6.rstrip().rstrip(",")},
n as (select volume_id, a as frn, count(*) as n from (select volume_id, frn, unnest(up) as a from down) t where a <> frn group by 1, 2),
f as ({_P6_FOUND.replace("lost as", "with recursive lost as", 1)})
select s.volume_id, s.frn, f.fault, d.depth, d.up[1] as root, d.path, coalesce(n.n, 0) as n_descendants
from state s left join down d using (volume_id, frn) left join n using (volume_id, frn) left join f using (volume_id, frn)""",
    "p6_descendants": f"""with {_P5} select * from (
with recursive {_P6.rstrip().rstrip(",")}
select volume_id, up[i] as ancestor_frn, frn, depth - i + 1 as distance
from (select *, unnest(range(1, depth + 1)) as i from down) t) t""",
}
