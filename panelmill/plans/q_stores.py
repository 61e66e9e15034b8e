"""Queries on kept scores, on a ledger published version by version, and on differences of stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.operators import ledger as G
from panelmill.operators import ranking as R
from panelmill.plans.base import E, P
from panelmill.plans.q_ledger import _LEDGER, _files_of, _results, _submissions
from panelmill.plans.registry import query
from panelmill.plans.scores import MODELS, RANK_FRACTION_SQL, SCORED_PERIOD, scores, scores_sql
from panelmill.session import spread, tasks_for
from panelmill.sources import digest_tree, files, score_store, snapshots
from panelmill.sources.tables import table

_CUTS = (100, 200, 300)
_RECIPE = {"target": "pesos", "columnas": ["mcuentas_saldo", "ctrx_quarter"]}


@query(
    "stored_scores_recut", "IO8 EN4 EN5 ML2 DQ11",
    scores_sql() + RANK_FRACTION_SQL + f""",
    ens as (select {E}, avg(rango) as score from fractions group by 1),
    puestos as (select *, row_number() over (order by score desc, {E}) as puesto from ens)
    select k as corte, count(*) as elegidos, min({E}) as primero, sum({E})::bigint as suma
    from puestos cross join (select unnest([{", ".join(map(str, _CUTS))}]) as k) where puesto <= k group by 1""",
)
def stored_scores_recut(spark, folder):
    """A stopped run is taken up again, then one month of what is stored is ensembled and cut without a fit."""
    path, every = files.shared_folder(spark, "score-store"), scores(spark, folder, every_period=True)

    def job(seed: int) -> DataFrame:
        return every.filter(F.col("modelo") == seed).select(E, P, "score")

    score_store.run(spark, path, _RECIPE, MODELS[:2], job)
    score_store.run(spark, path, _RECIPE, MODELS, job)
    ensemble = R.rank_ensemble(score_store.load(spark, path, _RECIPE, [SCORED_PERIOD]), model=["semilla"])
    return R.cuts(R.ranking(ensemble, hit=None), _CUTS).groupBy("corte").agg(
        F.count(F.lit(1)).alias("elegidos"), F.min(E).alias("primero"), F.sum(E).alias("suma")
    )


@query(
    "ledger_versions", "LG1 LG2 LG4 IO7",
    _LEDGER + """, b as (select s.id, s.nombre, s.estado, year(o.o_orderdate) >= 2000 as tarde, o.o_orderstatus as st, o.o_totalprice as p,
        coalesce(a.n, 0)::bigint as n_archivos
      from submit s join orders o on o.o_orderkey = s.id left join (select submit_id, count(*) as n from archivo group by 1) a on a.submit_id = s.id)
    select 1 as version, nombre, estado, n_archivos, case when st = 'F' then p end as public_gain_mean from b where not tarde
    union all select 2, nombre, case when tarde then 'preparado' else estado end, n_archivos, case when st = 'F' and not tarde then p end from b
    union all select 3, nombre, case when st = 'O' then 'respondido' when tarde then 'preparado' else estado end, n_archivos,
      case when st = 'O' then p / 2 when st = 'F' and not tarde then p end from b""",
)
def ledger_versions(spark, folder):
    """Submissions with their files, then results with the states they change, each published as one version; all versions read back."""
    path = files.shared_folder(spark, "ledger")
    subs, lines = _submissions(spark, folder), table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    tasks = tasks_for(spark, max(orders.count(), lines.count()))
    late = spread(orders.filter(F.year("o_orderdate") >= 2000).select(F.col("o_orderkey").alias("id")), tasks, "id")
    late_files, late_lines = late.withColumnRenamed("id", "submit_id"), late.withColumnRenamed("id", "l_orderkey")
    first = {"submit": subs.join(late, "id", "left_anti"), "archivo": _files_of(lines.join(late_lines, "l_orderkey", "left_anti")),
             "resultado": _results(spark, folder).join(late_files, "submit_id", "left_anti")}
    v1 = snapshots.publish(spark, path, first, 0)
    now = snapshots.read(spark, path, v1)
    new = subs.join(late, "id", "left_semi").drop("estado")
    added = G.append_submissions(now["submit"], now["archivo"], new, _files_of(lines.join(late_lines, "l_orderkey", "left_semi")), tasks)
    v2 = snapshots.publish(spark, path, dict(zip(("submit", "archivo"), added)), v1)
    now = snapshots.read(spark, path, v2)
    answers = table(spark, folder, "orders").filter("o_orderstatus = 'O'").select(
        F.concat(F.lit("s_"), F.col("o_orderkey").cast("string")).alias("nombre"), (F.col("o_totalprice") / 2).alias("public_gain_mean"))
    snapshots.publish(spark, path, dict(zip(("submit", "resultado"), G.record_results(now["submit"], now["resultado"], answers))), v2)
    return reduce(DataFrame.unionByName, [_version(spark, path, v) for v in (1, 2, 3)])


def _version(spark, path, version):
    t = snapshots.read(spark, path, version)
    counted = t["archivo"].groupBy(F.col("submit_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    told = t["submit"].join(counted, "id", "left").join(t["resultado"].withColumnRenamed("submit_id", "id"), "id", "left")
    return told.select(F.lit(version).alias("version"), "nombre", "estado", F.coalesce("n", F.lit(0)).cast("long").alias("n_archivos"),
                       "public_gain_mean")


@query(
    "digest_tree_differences", "IO14 LG7 LG10 ST7",
    _LEDGER + """, otra as (select id, nombre, experimento_id, case when id % 997 = 0 then 'fallido' else estado end as estado, es_final, enviado_en
        from submit where id % 1009 <> 0 union all select * from submit where id % 1013 = 0 and id % 997 <> 0 and id % 1009 <> 0)
    select *, 'izquierda' as solo_en from (select * from submit except all select * from otra)
    union all select *, 'derecha' from (select * from otra except all select * from submit)""",
)
def digest_tree_differences(spark, folder):
    """Submissions against a copy with changed, missing and repeated rows; only buckets whose digests differ are read."""
    path, subs = files.shared_folder(spark, "digests"), _submissions(spark, folder)
    key = F.col("id")
    changed = subs.filter(key % 1009 != 0).withColumn("estado", F.when(key % 997 == 0, "fallido").otherwise(F.col("estado")))
    repeated = subs.filter((key % 1013 == 0) & (key % 997 != 0) & (key % 1009 != 0))
    digest_tree.store(subs, f"{path}/a", ["id"], 64)
    digest_tree.store(changed.unionByName(repeated), f"{path}/b", ["id"], 64)
    return digest_tree.tree_differences(spark, f"{path}/a", f"{path}/b")
