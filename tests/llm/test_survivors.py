"""The surviving record of duplicate sets, against picking by hand."""

import datetime as dt

from siltstone.llm import survivors as m

CANDIDATE = "slot bigint, volume_id bigint, frn bigint, size bigint, print string, ok boolean, title string, trust int"
FACT = "fact_id bigint, slot bigint, size bigint, mtime bigint, owner string, title string, collector string, seen_at timestamp"
SEEN = dt.datetime(2024, 1, 1)
P = "0123456789abcdef0123456789abcdef"


def run(spark, candidates, facts, trust=(("a", 2), ("b", 1))):
    c = spark.createDataFrame([(*r, None, None) for r in candidates], CANDIDATE)  # columns of other tables' names
    out = m.survivors(c, spark.createDataFrame(facts, FACT), spark.createDataFrame(list(trust), "collector string, trust int"))
    return sorted(map(tuple, out.select("group_slot", "keep_slot", "members", "mtime", "owner", "title").collect()))


def test_spellings_names_and_sets(spark):
    rows = [(5, 1, 1, 10, P, True), (2, 1, 1, 10, "0x" + P.upper(), True), (7, 1, 2, 10, f"{{{P}}}", True), (9, 1, 3, 11, P, True), (8, 1, 4, 10, P, False), (4, 1, 5, 10, f" {P}\n", None)]
    assert run(spark, rows, []) == [(2, 2, 2, None, None, None)]


def test_most_trusted_then_latest_value_by_field(spark):
    rows = [(1, 1, 1, 10, P, True), (2, 1, 2, 10, P, True)]
    facts = [
        (1, 1, 0, 100, "ann", "n/a", "a", SEEN), (2, 1, 0, 200, "bob", "old", "b", SEEN + dt.timedelta(1)), (3, 1, 0, 300, " ", None, "a", SEEN + dt.timedelta(2)),
        (4, 2, 0, 0, "eve", None, "b", SEEN), (5, 2, 0, 10**18, None, None, "a", SEEN), (6, None, 1, 1, "x", "y", "a", None)]
    assert run(spark, rows, facts) == [(1, 1, 2, 300, "ann", "old")]


def test_ties_and_repeats(spark):
    rows = [(3, 1, 1, 10, P, True), (4, 1, 2, 10, P, True)] * 2
    facts = [(1, 3, 0, 5, "o", "t", "a", SEEN), (2, 4, 0, 5, "o", "t", "a", SEEN)] * 2
    assert run(spark, rows, facts) == [(3, 3, 2, 5, "o", "t")]


def test_unknown_collectors_come_last(spark):
    rows = [(1, 1, 1, 10, P, True), (2, 1, 2, 10, P, True)]
    assert run(spark, rows, [(1, 1, 0, 1, "x", None, "who", SEEN), (2, 1, 0, 2, "y", None, "b", None)])[0][3:5] == (2, "y")


def test_empty_and_null(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(None,) * 6, (1, None, 1, 1, P, True), (2, 1, None, 1, P, True), (3, 1, 1, None, P, True), (4, 1, 1, 1, None, True)], [(None,) * 8]) == []
