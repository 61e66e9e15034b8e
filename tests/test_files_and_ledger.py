"""Guarded exports, refusals to overwrite, manifests, ledger rules."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill import session
from panelmill.operators import ledger as G
from panelmill.sources import files as IO

E, P = K.ENTITY, K.PERIOD


def _ids(spark, ids):
    return spark.createDataFrame([(float(i),) for i in ids], f"{E} double")


def test_export_writes_plain_ascending_integers(spark, tmp_path):
    ids = [48_000_000, 31_100_000, 7, 12]
    path = str(tmp_path / "lista")
    assert IO.export_selection(_ids(spark, ids), path, valid=_ids(spark, [*ids, 99]), lowest=1, highest=10) == 4
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ["7", "12", "31100000", "48000000"]


@pytest.mark.parametrize("ids,valid,why", [([1], [1], "outside"), ([1, 1, 2], [1, 2], "repeated"), ([1, 2, 5], [1, 2], "not in the month")])
def test_export_refuses(spark, tmp_path, ids, valid, why):
    path = tmp_path / "lista"
    with pytest.raises(ValueError, match=why):
        IO.export_selection(_ids(spark, ids), str(path), valid=_ids(spark, valid), lowest=2, highest=10)
    assert not path.exists()


def test_panels_are_not_overwritten_unless_forced(spark, tmp_path):
    panel = spark.createDataFrame([(1.0, 202103, 2.5), (2.0, 202104, None)], f"{E} double, {P} int, mx double")
    path = str(tmp_path / "panel")
    IO.write_panel(panel, path)
    with pytest.raises(AnalysisException):
        IO.write_panel(panel, path)
    IO.write_panel(panel, path, force=True)
    back = IO.read_panel(spark, path, ["mx"], [202104])
    assert dict(back.dtypes)[E] == "bigint" and [tuple(r) for r in back.collect()] == [(2, 202104, None)]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [" in plan and P in plan.split("PartitionFilters")[1]


def test_text_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    rows = [(1, 'dijo "si"\ny otra línea'), (2, "  espacios , y comas  "), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id int, texto string")
    path = str(tmp_path / "csv")
    IO.export_ordered(df, path, ["id"])
    assert [tuple(r) for r in IO.read_text_csv(spark, path, df.schema).orderBy("id").collect()] == rows


def test_score_files_carry_their_seed(spark, tmp_path):
    scores = spark.createDataFrame([(1, 0.5), (2, 0.25)], f"{E} long, score double")
    for seed in (261431, 7):
        IO.write_scores(scores, str(tmp_path), seed, 202108)
    back = IO.read_scores(spark, str(tmp_path)).collect()
    assert sorted({(r.semilla, r[P]) for r in back}) == [(7, 202108), (261431, 202108)] and len(back) == 4


def test_manifest_detects_other_features(spark, tmp_path):
    path = str(tmp_path / "m")
    IO.write_manifest(spark, path, {"columnas": ["a", "b"], "n": 3})
    manifest = IO.read_manifest(spark, path)
    IO.require_same_features(manifest, ["a", "b"])
    with pytest.raises(ValueError):
        IO.require_same_features(manifest, ["b", "a"])


SUBMIT = "id long, nombre string, estado string, es_final boolean, enviado_en timestamp, notas string"


@pytest.fixture
def submits(spark):
    return spark.createDataFrame([(1, "exp_a_9000", "enviado", False, None, None), (2, "exp_b_9000", "preparado", True, None, "x")], SUBMIT)


@pytest.fixture
def files(spark):
    return spark.createDataFrame([(1, "a", "r/a"), (1, "b", "r/b"), (2, "a", "r/c")], "submit_id long, nombre string, ruta string")


def test_upsert_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "y", 6)], "id int, nombre string, t string, n int")
    new = spark.createDataFrame([("a", None, 9), ("c", "z", 1)], "nombre string, t string, n int")
    got = {r.nombre: (r.id, r.t, r.n) for r in G.upsert(old, new, "nombre").collect()}
    assert got == {"a": (1, "x", 9), "b": (2, "y", 6), "c": (None, "z", 1)}


def test_append_is_all_or_nothing(spark, submits, files):
    new = spark.createDataFrame([(3, "exp_c_9000")], "id long, nombre string")
    new_files = spark.createDataFrame([(3, "a", "r/d")], files.schema)
    s, f = G.append_submissions(submits, files, new, new_files)
    assert s.count() == 3 and f.count() == 4 and s.filter("id = 3").first().estado == "preparado"
    bad = [
        (new.withColumn("nombre", F.lit("exp_a_9000")), new_files, "already recorded"),
        (new.withColumn("nombre", F.lit("con espacio")), new_files, "other characters"),
        (new, new_files.unionByName(new_files), "file given twice"),
        (new, new_files.withColumn("submit_id", F.lit(8)), "without submission"),
    ]
    for n, nf, why in bad:
        with pytest.raises(ValueError, match=why):
            G.append_submissions(submits, files, n, nf)


def test_names_are_dealt_over_more_tasks_as_rows_grow(spark, submits, files, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    tasks = [session.tasks_for(spark, n) for n in (0, 10, 39, 400, 4_000)]
    assert tasks == [None, None, None, 40, 400]  # four cores take ten rows each without
    seen = []
    refuse = G._refuse
    monkeypatch.setattr(G, "_refuse", lambda rows, why: (seen.append(rows), refuse(rows, why)))
    new = spark.createDataFrame([(i, f"exp_{i}") for i in range(3, 403)], "id long, nombre string")
    new_files = spark.createDataFrame([(i, "a", "r") for i in range(3, 403)], files.schema)
    s, f = G.append_submissions(submits, files, new, new_files, tasks[3])
    assert s.count() == 402 and f.count() == 403
    assert seen[1].rdd.getNumPartitions() == 40  # not joined again into a few
    twice = new.unionByName(new.limit(1))
    with pytest.raises(ValueError, match="given twice"):
        G.append_submissions(submits, files, twice, new_files, tasks[3])


def test_states(submits):
    with pytest.raises(ValueError, match="invalid state"):
        G.set_state(submits, F.col("id") == 1, "perdido")
    when = F.lit(dt.datetime(2021, 8, 1))
    rows = {r.id: r for r in G.mark_sent(submits, F.col("estado") == "preparado", when).collect()}
    assert rows[2].estado == "enviado" and rows[2].enviado_en is not None and rows[1].enviado_en is None
    noted = {r.id: r for r in G.set_state(submits, F.col("estado") == "enviado", "fallido", "n").collect()}
    assert (noted[1].estado, noted[1].notas, noted[2].notas) == ("fallido", "n", "x")


def test_results_are_one_per_submission(spark, submits):
    results = spark.createDataFrame([], "submit_id long, public_gain_mean double")
    new = spark.createDataFrame([("exp_a_9000", 92.5)], "nombre string, public_gain_mean double")
    s, r = G.record_results(submits, results, new)
    assert s.filter("id = 1").first().estado == "respondido" and r.first().public_gain_mean == 92.5
    with pytest.raises(ValueError, match="already recorded"):
        G.record_results(s, r, new)
    with pytest.raises(ValueError, match="no such submission"):
        G.record_results(submits, results, new.withColumn("nombre", F.lit("nada")))


def test_purge_spares_final_submissions(spark, submits, files):
    results = spark.createDataFrame([(1, 50.0), (2, 10.0)], "submit_id long, public_gain_mean double")
    assert {r.ruta for r in G.purgeable(submits, files, results, 60.0).collect()} == {"r/a", "r/b"}
    assert G.purgeable(submits, files, results).count() == 0


def test_digest_ignores_order_and_sees_changes(spark, files):
    a, b = (G.table_digest(d).first() for d in (files, files.orderBy(F.desc("ruta")).repartition(3)))
    c = G.table_digest(files.withColumn("ruta", F.lit("otra"))).first()
    assert a == b and a != c


def test_cut_comes_from_the_name_or_the_fallback(spark):
    df = spark.createDataFrame([("exp_lags_14000", 1), ("exp_ens", 9000), ("exp_100", 5), ("x_123456", 7)], "n string, f int")
    got = [r[0] for r in df.select(G.cut_from_name(F.col("n"), F.col("f"))).collect()]
    assert got == [14000, 9000, 5, 23456]


def test_config_signature_ignores_the_seed():
    a = G.config_signature({"seed": 1, "x": 2})
    assert a == G.config_signature({"x": 2, "seed": 9}) and a != G.config_signature({"x": 3}) and len(a) == 16


def test_digest_tells_separators_nulls_and_names_apart(spark):
    def digest(rows, names="a string, b string"):
        return G.table_digest(spark.createDataFrame(rows, names)).first()

    first = digest([("x|y", "z"), ("~", "q")])
    assert first == digest([("~", "q"), ("x|y", "z")])
    for other in ([("x", "y|z"), (None, "q")], [("x|y", "z"), ("null", "q")], [("x|y", "z"), (None, "q")], [("x|y;b=1:", "z"), ("~", "q")]):
        assert digest(other) != first
    assert digest([("x|y", "z"), ("~", "q")], "a string, c string") != first
