"""Parent-child links to full hierarchies: faults, depth, path, root and descendants of every node.

The forest is cut into fragments of bounded size. Each fragment contracts its own
parent chains to the node where they leave it (its exit), a root, or a local cycle. The exits form a smaller
quotient forest, which is solved in the same way, recursively, until one fragment holds it; the answers are then expanded back. A node
joins its parent's fragment where a coin of its own shows tails and its parent's shows heads, so a fixed
share of all links is contracted at each level whatever the shape of the trees. Cycles inside a fragment
are found there, longer ones at the level of the quotient where they close, and are carried back along
the local chains that belong to them. Children of a hot parent stay apart from it; where that keeps a quotient from shrinking, it is
solved by doubling every node's parent link with joins.

Only nodes that are somebody's parent take part; leaves get their answer from one join with their parents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize

KEY = ["volume_id", "frn"]
FRAGMENT_ROWS = 400_000
SHRINKS = 0.95  # a quotient of this share of its forest or more is not contracted further
LEAST_FRAGMENTS = 8  # of the first level, however small the forest
ROOT, EXIT, ORPHAN, CYCLE, BELOW = "root", "exit", "orphan", "cycle", "below_cycle"
SEP = "\\"

LOCAL = "volume_id bigint, frn bigint, bucket int, kind string, top bigint, exit_parent bigint, segs array<struct<frn:bigint,name:string>>, hops bigint"


def _chains(frn: np.ndarray, parent: np.ndarray, stop: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, ...]:
    """Follow parents inside the fragment, all nodes at once, by doubling.

    Returns each node's last node, whether the chain never ends (it runs into a cycle), whether the node lies on that cycle,
    the sum of the links' lengths and the number of links to the last node, and the next node up.
    """
    n = len(frn)
    order = np.argsort(frn, kind="stable")
    at = np.searchsorted(frn[order], parent)
    at_c = np.minimum(at, n - 1)
    inside = (frn[order][at_c] == parent) & ~stop
    up = np.where(inside, order[at_c], np.arange(n))
    end = ~inside
    jump, hops, steps = up.copy(), np.where(inside, link, 0), inside.astype(np.int64)
    for _ in range(max(1, int(np.ceil(np.log2(n + 1)))) + 1):
        hops, steps = hops + hops[jump], steps + steps[jump]
        jump = jump[jump]
    endless = ~end[jump]
    on = np.zeros(n, bool)
    on[jump[endless]] = True  # past every tail, the jumps land on the cycles, and each of their nodes is landed on by another
    hops[endless] = steps[endless] = 0
    return jump, endless, on, hops, steps, up


def _local(with_segs: bool, last: bool):
    """One fragment: (volume, frn, parent, whether it is known, stop, segs of the link, hops of the link) -> LOCAL."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        frn, n = pdf.frn.to_numpy(np.int64), len(pdf)
        known, parent = pdf.known.to_numpy(bool), pdf.parent_frn.to_numpy(np.int64)
        stop = pdf.stop.to_numpy(bool) | ~known
        top, endless, on, hops, steps, up = _chains(frn, parent, stop, pdf.hops.to_numpy(np.int64))
        kind = np.where(endless, np.where(on, CYCLE, BELOW), np.where(pdf.stop.to_numpy(bool)[top], ROOT, EXIT))
        # without a parent, or in the only fragment with a parent nobody is: the chain ends at nothing
        lost = (kind == EXIT) & (~known[top] | last)
        kind = np.where(lost, ORPHAN, kind)
        segs = [[] for _ in range(n)] if with_segs else None
        if with_segs:
            own = pdf.segs.to_list()
            for i in np.argsort(steps, kind="stable"):  # parents first
                if steps[i]:
                    segs[i] = segs[up[i]] + list(own[i])
        return pd.DataFrame({"volume_id": pdf.volume_id.to_numpy(), "frn": frn, "bucket": pdf.bucket.to_numpy(), "kind": kind, "top": frn[top], "exit_parent": pd.array(np.where(kind == EXIT, parent[top], 0), dtype="Int64"), "segs": segs if with_segs else [[]] * n, "hops": hops})

    return solve


def _mark(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a fragment (left) on the way up from the nodes where a global cycle enters it (right)."""
    if not len(left) or not len(right):
        return pd.DataFrame({"volume_id": pd.array([], "int64"), "frn": pd.array([], "int64")})
    frn, parent = left.frn.to_numpy(np.int64), left.parent_frn.to_numpy(np.int64)
    order = np.argsort(frn, kind="stable")
    ranks = frn[order]

    def find(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(ranks, x), len(frn) - 1)
        return order[at][ranks[at] == x]

    on = np.zeros(len(frn), bool)
    front = np.unique(find(right.frn.to_numpy(np.int64)))
    while len(front):
        on[front] = True
        front = np.unique(find(parent[front]))
        front = front[~on[front]]
    return pd.DataFrame({"volume_id": left.volume_id.to_numpy()[on], "frn": frn[on]})


def _coin(c: str, level: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(level), F.col("volume_id"), F.col(c)), F.lit(2)) == 0


def _solve(links: DataFrame, level: int, with_segs: bool, fragment_rows: int) -> DataFrame:
    """links (volume_id, frn, parent_frn, stop, segs, hops), materialised -> (volume_id, frn, fault, depth, chain)."""
    n = links.count()
    buckets = -(-n // fragment_rows)
    if level == 0:
        buckets = max(buckets, LEAST_FRAGMENTS)
    if buckets <= 1:
        placed = links.withColumn("bucket", F.lit(0))
    else:
        own = F.pmod(F.xxhash64(F.lit(-1 - level), F.col("volume_id"), F.col("frn")), F.lit(buckets * 2))
        theirs = F.pmod(F.xxhash64(F.lit(-1 - level), F.col("volume_id"), F.col("parent_frn")), F.lit(buckets * 2))
        # children of a hot parent stay apart, or its fragment would grow with them
        hot = links.groupBy("volume_id", "parent_frn").count().filter(F.col("count") > max(8, min(fragment_rows, n // buckets) // 8)).drop("count")
        # joined by name: hot comes from links itself, so its columns can't be told apart by reference
        placed = links.join(hot.withColumn("is_hot", F.lit(True)), ["volume_id", "parent_frn"], "left")
        moves = F.col("is_hot").isNull() & ~F.col("stop") & ~_coin("frn", level) & _coin("parent_frn", level)
        placed = placed.withColumn("bucket", F.when(moves, theirs).otherwise(own).cast("int")).drop("is_hot")
    groups = ["volume_id", "bucket"]  # a fragment holds one volume's nodes only
    # a bigint with nulls reaches pandas as float64, which is exact to 2^53 only
    placed = placed.withColumn("known", F.col("parent_frn").isNotNull()).withColumn("parent_frn", F.coalesce("parent_frn", F.lit(0).cast("bigint")))
    local = placed.groupBy(groups).applyInPandas(_local(with_segs, buckets <= 1), LOCAL)
    if buckets <= 1:
        return local.select(*KEY, F.when(F.col("kind") != ROOT, F.col("kind")).alias("fault"), F.when(F.col("kind") == ROOT, F.col("hops")).alias("depth"), F.when(F.col("kind") == ROOT, F.col("segs")).alias("chain"), "top")
    local = materialize(local, "fragments")
    exits = local.filter((F.col("kind") == EXIT) & (F.col("frn") == F.col("top"))).select("volume_id", F.col("frn").alias("x"), "exit_parent")
    p = local.select("volume_id", F.col("frn").alias("exit_parent"), F.col("kind").alias("p_kind"), F.col("top").alias("p_top"), F.col("segs").alias("p_segs"), F.col("hops").alias("p_hops"))
    own_link = links.select("volume_id", F.col("frn").alias("x"), "segs", "hops")
    q = exits.join(p, ["volume_id", "exit_parent"], "left").join(own_link, ["volume_id", "x"])
    q = materialize(q.select("volume_id", "x", "exit_parent", "p_kind", "p_top", (F.col("p_hops") + F.col("hops")).alias("hops"), F.concat("p_segs", "segs").alias("segs")), "quotient")
    # an exit's parent is nobody; leads to a root or into a local cycle; or hangs on another exit
    direct = q.filter(F.col("p_kind").isNull() | (F.col("p_kind") != EXIT)).select(
        "volume_id", F.col("x").alias("top"),
        F.when(F.col("p_kind").isNull() | (F.col("p_kind") == ORPHAN), ORPHAN).when(F.col("p_kind").isin(CYCLE, BELOW), BELOW).alias("fault"),
        F.when(F.col("p_kind") == ROOT, F.col("hops")).alias("depth"), F.when(F.col("p_kind") == ROOT, F.col("segs")).alias("chain"), F.col("p_top").alias("root"))
    inner = q.filter(F.col("p_kind") == EXIT)
    # exits that were settled directly end the chains of the others: they stop them in the smaller forest
    sub = materialize(
        inner.select("volume_id", F.col("x").alias("frn"), F.col("p_top").alias("parent_frn"), F.lit(False).alias("stop"), "segs", "hops")
        .unionByName(direct.select("volume_id", F.col("top").alias("frn"), F.lit(None).cast("bigint").alias("parent_frn"), F.lit(True).alias("stop"), F.array().cast("array<struct<frn:bigint,name:string>>").alias("segs"), F.lit(0).cast("bigint").alias("hops"))), "forest")
    rest = _solve if sub.count() < n * SHRINKS else _doubled
    solved = materialize(rest(sub, level + 1, with_segs, fragment_rows).select("volume_id", "frn", "fault", "depth", "chain", F.col("top").alias("settled")), "solved")
    d = direct.select("volume_id", F.col("top").alias("settled"), F.col("fault").alias("d_fault"), F.col("depth").alias("d_depth"), F.col("chain").alias("d_chain"), "root")
    tops = solved.join(d, ["volume_id", "settled"], "left").select(
        "volume_id", F.col("frn").alias("top"),
        F.coalesce("fault", "d_fault").alias("t_fault"), (F.col("depth") + F.col("d_depth")).alias("t_depth"), F.concat("d_chain", "chain").alias("t_chain"), "root")
    # a cycle through several fragments: the ways from where it enters a fragment to that fragment's exit
    entries = inner.join(solved.filter(F.col("fault") == CYCLE).select("volume_id", F.col("frn").alias("x")), ["volume_id", "x"], "left_semi")
    entries = entries.select("volume_id", F.col("exit_parent").alias("frn")).join(local.select(*KEY, "bucket"), KEY)
    circled = local.join(solved.filter(F.col("fault") == CYCLE).select("volume_id", F.col("frn").alias("top")), ["volume_id", "top"], "left_semi")
    circled = circled.select(*KEY, "bucket").join(links.select(*KEY, "parent_frn"), KEY)
    entries = entries.select(F.col("volume_id").alias("e_volume"), "frn", F.col("bucket").alias("e_bucket"))  # both sides come from local
    marked = circled.groupBy("volume_id", "bucket").cogroup(entries.groupBy("e_volume", "e_bucket")).applyInPandas(_mark, "volume_id bigint, frn bigint").withColumn("marked", F.lit(True))
    out = local.join(tops, ["volume_id", "top"], "left").join(marked, KEY, "left")
    kind, exit_ = F.col("kind"), F.col("kind") == EXIT
    fault = F.when(exit_ & F.col("t_fault").isin(CYCLE, BELOW), F.when(F.col("marked"), CYCLE).otherwise(BELOW)).when(exit_, F.col("t_fault")).when(kind != ROOT, kind)
    return out.select(
        *KEY, fault.alias("fault"),
        F.when(exit_, F.col("t_depth") + F.col("hops")).when(kind == ROOT, F.col("hops")).alias("depth"),
        F.when(exit_, F.concat("t_chain", "segs")).when(kind == ROOT, F.col("segs")).alias("chain"),
        F.coalesce(F.when(exit_, F.col("root")), F.col("top")).alias("top"))


def _doubled(links: DataFrame, level: int, with_segs: bool, fragment_rows: int) -> DataFrame:
    """What _solve gives, by joining every node with the node its link has reached, and so doubling all links.

    The chains' nodes are only carried once the endless chains are known, whose lists would double as well.
    """
    rounds = max(1, (links.count() + 1).bit_length()) + 1
    ends = F.col("stop") | F.col("parent_frn").isNull()
    state = links.select(*KEY, F.when(ends, F.col("frn")).otherwise(F.col("parent_frn")).alias("to"), ends.alias("done"), F.lit(False).alias("lost"), F.when(F.col("stop"), 0).otherwise(F.col("hops")).alias("hops"), F.when(F.col("stop"), F.slice("segs", 1, 0)).otherwise(F.col("segs")).alias("segs"))

    def doubled(s: DataFrame, carried: bool) -> DataFrame:
        for _ in range(rounds):
            s = materialize(s, "doubled")
            if s.filter("not done").isEmpty():
                break
            ahead = s.select("volume_id", F.col("frn").alias("to"), F.col("to").alias("a_to"), F.col("done").alias("a_done"), F.col("lost").alias("a_lost"), F.col("hops").alias("a_hops"), F.col("segs").alias("a_segs"))
            far = s.filter("not done").join(ahead, ["volume_id", "to"], "left")
            gone = F.col("a_to").isNull()  # a parent that is no node
            far = far.select(*KEY, F.coalesce("a_to", "to").alias("to"), F.when(gone, True).otherwise(F.col("a_done")).alias("done"), F.when(gone, True).otherwise(F.col("a_lost")).alias("lost"), (F.col("hops") + F.coalesce("a_hops", F.lit(0))).alias("hops"), F.when(gone | F.lit(not carried), F.col("segs")).otherwise(F.concat("a_segs", "segs")).alias("segs"))
            s = s.filter("done").unionByName(far)
        return materialize(s, "doubled")

    plain = doubled(state.withColumn("segs", F.slice("segs", 1, 0)), False)
    endless = plain.filter("not done")
    on = endless.select("volume_id", F.col("to").alias("frn")).distinct().withColumn("on", F.lit(True))
    circling = endless.select(KEY).join(on, KEY, "left").select(*KEY, F.when(F.col("on"), CYCLE).otherwise(BELOW).alias("fault"), F.lit(None).cast("bigint").alias("depth"), F.lit(None).cast("array<struct<frn:bigint,name:string>>").alias("chain"), F.col("frn").alias("top"))
    whole = doubled(state.join(endless.select(KEY), KEY, "left_anti"), True) if with_segs else plain.filter("done")
    stops = links.filter("stop").select("volume_id", F.col("frn").alias("to"), F.lit(True).alias("sound"))
    out = whole.join(stops, ["volume_id", "to"], "left")
    sound = F.col("sound") & ~F.col("lost")
    fine = out.select(*KEY, F.when(sound, F.lit(None)).otherwise(ORPHAN).alias("fault"), F.when(sound, F.col("hops")).alias("depth"), F.when(sound, F.col("segs")).alias("chain"), F.col("to").alias("top"))
    return fine.unionByName(circling)


def hierarchy(nodes: DataFrame, roots: DataFrame, with_chain: bool = True, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """nodes (volume_id, frn, parent_frn, name), roots (volume_id, frn) ->
    (volume_id, frn, fault, depth, root, chain): chain lists the nodes from below the root down to the node.

    fault is null for a node that leads to its volume's root; 'cycle' on a cycle (its own parent included),
    'below_cycle' when led into one, 'orphan' when led to a frn that is no node, or to null. depth, root and
    chain are null with a fault; the root itself has depth 0 and an empty chain. A volume without a living root
    has no sound node. (volume_id, frn) must be unique; nodes with a null in it are not nodes.
    """
    roots = roots.select("volume_id", "frn").filter("frn is not null").distinct().withColumn("stop", F.lit(True))
    nodes = nodes.select(*KEY, "parent_frn", "name").filter("volume_id is not null and frn is not null")
    parents = nodes.select("volume_id", F.col("parent_frn").alias("frn")).distinct()
    seg = F.array(F.struct("frn", "name")) if with_chain else F.array().cast("array<struct<frn:bigint,name:string>>")
    nodes = nodes.join(roots, KEY, "left").withColumn("stop", F.coalesce("stop", F.lit(False)))
    inner = nodes.join(parents, KEY, "left_semi")
    links = materialize(inner.select(*KEY, "parent_frn", "stop", seg.alias("segs"), F.lit(1).cast("bigint").alias("hops")), "links")
    solved = materialize(_solve(links, 0, with_chain, fragment_rows).select(*KEY, "fault", "depth", "chain", F.when(F.col("fault").isNull(), F.col("top")).alias("root")), "forest")
    leaves = nodes.join(parents, KEY, "left_anti")
    p = solved.select("volume_id", F.col("frn").alias("parent_frn"), F.lit(True).alias("there"), F.col("fault").alias("p_fault"), F.col("depth").alias("p_depth"), F.col("chain").alias("p_chain"), F.col("root").alias("p_root"))
    lone = F.col("stop")  # a root without children
    leaves = leaves.join(p, ["volume_id", "parent_frn"], "left").select(
        *KEY,
        F.when(lone, F.lit(None)).when(F.col("there").isNull(), ORPHAN).when(F.col("p_fault") == CYCLE, BELOW).otherwise(F.col("p_fault")).alias("fault"),
        F.when(lone, F.lit(0)).otherwise(F.col("p_depth") + 1).alias("depth"),
        F.when(lone, F.array().cast("array<struct<frn:bigint,name:string>>")).otherwise(F.concat("p_chain", seg)).alias("chain"),
        F.when(lone, F.col("frn")).otherwise(F.col("p_root")).alias("root"))
    return solved.select("volume_id", "frn", "fault", "depth", "root", "chain").unionByName(leaves)


def faults(nodes: DataFrame, roots: DataFrame, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    return hierarchy(nodes, roots, False, fragment_rows).filter("fault is not null").select(*KEY, "fault")


def full_paths(found: DataFrame, drives: DataFrame | None = None) -> DataFrame:
    """Adds path, X:\\a\\b, to the rows of hierarchy(); null with a fault. drives (volume_id, drive)."""
    names = F.transform("chain", lambda s: F.coalesce(s["name"], F.lit("")))
    if drives is None:
        return found.withColumn("path", F.array_join(names, SEP))
    out = found.join(drives.groupBy("volume_id").agg(F.max("drive").alias("drive")), "volume_id", "left")
    lead = F.array(F.concat(F.coalesce("drive", F.lit("?")), F.lit(":")))
    return out.withColumn("path", F.array_join(F.concat(lead, names), SEP)).drop("drive")


def descendants(found: DataFrame) -> DataFrame:
    """(volume_id, ancestor_frn, frn, distance): every node under every node above it, the root included."""
    d = found.filter("fault is null and depth > 0")
    above = F.concat(F.array("root"), F.slice(F.transform("chain", lambda s: s["frn"]), 1, F.size("chain") - 1))
    e = d.select("volume_id", "frn", "depth", F.posexplode(above).alias("pos", "ancestor_frn"))
    return e.select("volume_id", "ancestor_frn", "frn", (F.col("depth") - F.col("pos")).alias("distance"))


def descendant_counts(found: DataFrame) -> DataFrame:
    n = descendants(found).groupBy("volume_id", "ancestor_frn").agg(F.count("*").alias("n_descendants"))
    return found.join(n.withColumnRenamed("ancestor_frn", "frn"), KEY, "left").na.fill(0, ["n_descendants"])
