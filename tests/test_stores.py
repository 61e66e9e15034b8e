"""Versions published together, kept scores, differences by digests."""

import pytest
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.operators.label import differences
from panelmill.sources import digest_tree, score_store, snapshots

E, P = K.ENTITY, K.PERIOD


def _rows(df):
    return sorted(map(tuple, df.collect()))


# --- snapshots --------------------------------------------------------------------------------

def _frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x int")


def test_versions_change_together_and_stay_readable(spark, tmp_path):
    folder = str(tmp_path)
    assert snapshots.latest(spark, folder) == 0 and snapshots.read(spark, folder) == {}
    assert snapshots.publish(spark, folder, {"a": _frame(spark, 1), "b": _frame(spark, 10)}, 0) == 1
    assert snapshots.publish(spark, folder, {"a": _frame(spark, 1, 2)}, 1) == 2
    now, before = snapshots.read(spark, folder), snapshots.read(spark, folder, 1)
    assert (_rows(now["a"]), _rows(now["b"])) == ([(1,), (2,)], [(10,)])
    assert (_rows(before["a"]), _rows(before["b"])) == ([(1,)], [(10,)])


def test_a_failure_between_two_writes_leaves_the_old_version(spark, tmp_path):
    folder = str(tmp_path)
    snapshots.publish(spark, folder, {"a": _frame(spark, 1), "b": _frame(spark, 10)}, 0)
    broken = _frame(spark, 11).select(F.raise_error(F.lit("lost")).cast("int").alias("x"))
    with pytest.raises(Exception, match="lost"):
        snapshots.publish(spark, folder, {"a": _frame(spark, 2), "b": broken}, 1)
    now = snapshots.read(spark, folder)
    assert (snapshots.latest(spark, folder), _rows(now["a"]), _rows(now["b"])) == (1, [(1,)], [(10,)])


def test_who_publishes_second_is_refused(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    snapshots.publish(spark, folder, {"a": _frame(spark, 1)}, 0)
    snapshots.publish(spark, folder, {"a": _frame(spark, 2)}, 1)
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, folder, {"a": _frame(spark, 3)}, 1)
    monkeypatch.setattr(snapshots, "latest", lambda *_: 1)  # both looked before either published
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, folder, {"a": _frame(spark, 3)}, 1)
    monkeypatch.undo()
    assert _rows(snapshots.read(spark, folder)["a"]) == [(2,)]


# --- scores -----------------------------------------------------------------------------------

CONFIG = {"target": "pesos", "columnas": ["x", "z"]}


def _scores(spark, seed, periods=(202105, 202106)):
    return spark.createDataFrame([(e, p, seed + e / 10) for e in range(5) for p in periods], f"{E} long, {P} int, score double")


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    folder, asked = str(tmp_path), []

    def job(seed):
        asked.append(seed)
        return _scores(spark, seed)

    assert score_store.run(spark, folder, CONFIG, [1, 2], job) == [1, 2]
    # seed 3 was stopped after some of its scores: no line says it is finished
    half = _scores(spark, 99, (202105,)).withColumns({"firma": F.lit(score_store.key_of(CONFIG)), "semilla": F.lit(3).cast("long")})
    half.write.mode("append").partitionBy("firma", "semilla", P).parquet(f"{folder}/scores")
    assert {r.semilla for r in score_store.load(spark, folder, CONFIG).select("semilla").distinct().collect()} == {1, 2}
    assert score_store.run(spark, folder, CONFIG, [1, 2, 3], job) == [3] and asked == [1, 2, 3]
    want = sorted((e, p, s, s + e / 10) for s in (1, 2, 3) for e in range(5) for p in (202105, 202106))
    assert _rows(score_store.load(spark, folder, CONFIG)) == want


def test_other_columns_are_refused_and_other_recipes_kept_apart(spark, tmp_path):
    folder = str(tmp_path)
    score_store.save(_scores(spark, 1), folder, CONFIG, 1)
    with pytest.raises(ValueError, match="features differ"):
        score_store.run(spark, folder, {**CONFIG, "columnas": ["x"]}, [2], lambda s: _scores(spark, s))
    other = {**CONFIG, "target": "baja2"}
    assert score_store.run(spark, folder, other, [1], lambda s: _scores(spark, 7)) == [1]
    assert {r.score for r in score_store.load(spark, folder, other).filter(f"{E} = 0").collect()} == {7.0}
    assert {r.score for r in score_store.load(spark, folder, CONFIG).filter(f"{E} = 0").collect()} == {1.0}


def test_configuration_seed_and_period_prune_folders(spark, tmp_path):
    folder = str(tmp_path)
    for seed in (1, 2):
        score_store.save(_scores(spark, seed), folder, CONFIG, seed)
    loaded = score_store.load(spark, folder, CONFIG, [202106])
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "firma" in pruned and "semilla" in pruned and P in pruned
    assert loaded.count() == 10


# --- differences ------------------------------------------------------------------------------

def test_differences_read_only_buckets_that_differ(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(digest_tree, "FAN", 3)
    rows = [(i, f"v{i}", None if i % 5 == 0 else i * 1.5) for i in range(2_000)] + [(None, "sin clave", 1.0)]
    left = spark.createDataFrame(rows, "k long, t string, x double")
    changed = [(k, "otro" if k == 77 else t, x) for k, t, x in rows if k != 500] + [rows[900], (5_000, "nuevo", None)]
    right = spark.createDataFrame(changed, left.schema)
    paths = [str(tmp_path / side) for side in "ab"]
    for df, path in zip((left, right), paths):
        digest_tree.store(df, path, ["k"], 20)  # three levels
    buckets = digest_tree.differing_buckets(spark, *paths)
    own = F.pmod(F.xxhash64("k"), F.lit(20))
    want = {r[0] for r in spark.createDataFrame([(k,) for k in (77, 500, 900, 5_000)], "k long").select(own).collect()}
    assert set(buckets) == want
    got = digest_tree.tree_differences(spark, *paths)
    assert _rows(got.fillna(-1.0)) == _rows(differences(left, right).fillna(-1.0)) and got.count() == 5
    read = digest_tree.rows_of(spark, paths[0], buckets, spark.read.parquet(f"{paths[0]}/columns").schema)
    assert {r[0] for r in read.select(digest_tree.BUCKET).distinct().collect()} <= want
    assert "PartitionFilters: [" + digest_tree.BUCKET in read._jdf.queryExecution().executedPlan().toString()


def test_equal_and_empty_tables_do_not_differ(spark, tmp_path):
    df = spark.range(50).withColumnRenamed("id", "k")
    for name, frame in {"a": df, "b": df.orderBy(F.desc("k")), "c": df.limit(0), "d": df.limit(0)}.items():
        digest_tree.store(frame, str(tmp_path / name), ["k"], 8)
    at = lambda n: str(tmp_path / n)
    assert digest_tree.differing_buckets(spark, at("a"), at("b")) == [] == digest_tree.differing_buckets(spark, at("c"), at("d"))
    assert digest_tree.tree_differences(spark, at("a"), at("b")).count() == 0
    assert digest_tree.tree_differences(spark, at("a"), at("c")).count() == 50


def test_texts_of_files_are_made_after_their_lines_are_joined(spark, tmp_path):
    """Joined as files, every line carried its name and path through the shuffle; versions were written without zstd."""
    from panelmill.plans.q_ledger import _files_of

    lines = spark.range(50).selectExpr("id as l_orderkey", "1 as l_linenumber", "2 as l_partkey", "3 as l_suppkey", "4.0d as l_quantity")
    late = spark.range(40, 60).withColumnRenamed("id", "l_orderkey")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        listed = _files_of(lines.join(late, "l_orderkey", "left_anti"))
        plan = listed._jdf.queryExecution().executedPlan().toString()
        assert plan.index("concat_ws") < plan.index("SortMergeJoin") and plan.count("concat_ws") <= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    snapshots.publish(spark, str(tmp_path / "v"), {"archivo": listed}, 0)
    written = [p.name for p in (tmp_path / "v").rglob("part-*.parquet")]
    assert written and all(".zstd." in name for name in written)
    assert sorted(r.submit_id for r in snapshots.read(spark, str(tmp_path / "v"))["archivo"].collect()) == list(range(40))
