"""Exact dedup and sharding: defined cases, brute force, movement of rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from panelmill.llm import exact, sharding

ROWS = [
    (3, "a b"), (1, "ab"), (2, "a\tb\n"), (7, "AB"), (4, None), (5, ""), (6, " \n"), (None, "ab"), (8, "long " * 30_000), (9, "long" * 30_000),
    (10, "same"), (10, "same"), (10, "same"), (11, "a b"), (12, "é"), (13, "é"),
]


def _best(rows):
    groups = {}
    for at, (i, t) in enumerate(rows):
        t = t or ""
        bare = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(bare, []).append((-len(t), i is None, i, at))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}


def test_decisions_match_brute_force(docs):
    got = exact.decide(docs(*ROWS)).collect()
    want = _best(ROWS)
    assert len(got) == len(ROWS)
    assert sorted((r.keep_id, r.group_size) for r in got if r.kept) == sorted(want.values(), key=lambda x: (x[0] is None, x))
    assert sum(r.kept for r in got) == len(want)
    assert all(r.keep_id == 2 and r.group_size == 4 for r in got if r.doc_id in (1, 2, 3))  # 2 has the most code points
    assert all(r.keep_id == 6 for r in got if r.doc_id in (4, 5, 6))


def test_hot_group_over_many_runs(spark, docs):
    many = docs((0, "x")).select("text").crossJoin(spark.range(0, 5_000, 1, 23)).select(F.col("id").alias("doc_id"), "text")
    got = exact.decide(many)
    assert got.filter("kept").collect()[0].doc_id == 0 and got.filter("kept").count() == 1
    assert got.agg(F.min("group_size"), F.max("group_size")).first()[:] == (5_000, 5_000)


def test_kept_rows_carry_their_columns(docs):
    frame = docs(*ROWS)
    kept = exact.unique(frame)
    assert kept.columns == frame.columns
    want = _best(ROWS)
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x or 0)) == sorted(
        (i for i, _ in want.values()), key=lambda x: (x is None, x or 0))


@pytest.mark.parametrize("work", [exact.decide, exact.unique, lambda d: sharding.placed(d, sharding.even_tree(8))])
def test_empty_tables(docs, work):
    assert work(docs()).count() == 0


def test_no_python_on_the_native_paths(docs):
    frame = docs(*ROWS)
    for df in (exact.decide(frame), exact.unique(frame), sharding.placed(frame, sharding.even_tree(8))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))


def test_shards_slots_sizes_and_checksums(docs):
    tree = sharding.even_tree(8)
    rows = sharding.placed(docs(*ROWS), tree, sharding.grown(tree, 8)).collect()
    assert len(rows) == len(ROWS)
    texts = {i: t for i, t in ROWS if i is not None}
    for r in rows:
        body = ((texts[r.doc_id] if r.doc_id is not None else "ab") or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
        assert r.grown_shard in (r.shard, 8)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def _shards(spark, tree, n=4_000):
    return {r.id: r.s for r in spark.range(n).select("id", sharding.shard_of(F.col("id"), tree).alias("s")).collect()}


def test_weights_set_the_shares(spark):
    tree = {"a": {"x": {0: 1.0, 1: 3.0}, "y": {2: 0.0}}, "b": {"z": {3: 4.0}}}
    got = list(_shards(spark, tree).values())
    for shard, share in ((0, 1 / 8), (1, 3 / 8), (2, 0), (3, 1 / 2)):
        assert abs(got.count(shard) / len(got) - share) < 0.03


def test_movement_stays_in_subtrees_whose_weight_changes(spark):
    tree = sharding.even_tree(8)
    heavier = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.items()}
    heavier["r1"]["k2"][5] = 3.0
    before, after = _shards(spark, tree), _shards(spark, heavier)
    moved = {(before[i], after[i]) for i in before if before[i] != after[i]}
    assert moved and all(new in (4, 5, 6, 7) for _, new in moved)  # only into the region whose weight rose
    assert all(new in (4, 5) for old, new in moved if old in (6, 7))  # within it, only into the rack whose weight rose
    assert all(new == 5 for old, new in moved if old == 4)  # within that, only into the shard


def test_a_new_shard_takes_rows_only_into_itself(spark):
    tree = sharding.even_tree(8)
    for shard in (8, 9, 10):
        more = sharding.grown(tree, shard)
        before, after = _shards(spark, tree), _shards(spark, more)
        moved = [i for i in before if before[i] != after[i]]
        assert moved and all(after[i] == shard for i in moved)
        assert abs(len(moved) / len(before) - 1 / (shard + 1)) < 0.03
        tree = more
