"""Score tables derived from the labelled panel: five models that see one truth through noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.functions.draws import uniform
from panelmill.plans.base import E, L, P, labelled, labelled_sql
from panelmill.session import checkpoint

MODELS = (1, 2, 3, 4, 5)
SCORED_PERIOD = 202106
_COLUMNS = ["mcuentas_saldo", "ctrx_quarter", "cpayroll_trx", "cproductos"]




def scores(spark: SparkSession, folder: str, every_period: bool = False) -> DataFrame:
    """(entity, period, flags, positivo, modelo, score), materialised once for its several readers."""
    panel = labelled(spark, folder, _COLUMNS).filter(F.col(L).isNotNull())
    if not every_period:
        panel = panel.filter(F.col(P) == SCORED_PERIOD)
    noise = uniform(E, P, "modelo")
    long = panel.withColumn("modelo", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    score = (
        F.lit(0.5) * F.floor(noise * 100) / 100
        + F.lit(0.3) * F.when(F.col("mcuentas_saldo") < 0, 1).otherwise(0)
        + F.lit(0.2) * F.when(F.col("ctrx_quarter") == 0, 1).otherwise(0)
    )
    return checkpoint(long.select(
        E, P, *_COLUMNS, (F.col(L) == K.LEAVES_IN_TWO).cast("int").alias("positivo"), "modelo", score.alias("score"),
    ))


def uniform_sql(*parts: str) -> str:
    text = " || '_' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"((('0x' || substr(md5({text}), 1, 8))::bigint % 1000000) / 1000000.0::double)"


def scores_sql(every_period: bool = False) -> str:
    where = "" if every_period else f"and {P} = {SCORED_PERIOD}"
    noise = uniform_sql(E, P, "modelo")
    return labelled_sql(_COLUMNS) + f""",
scores as (
  select {E}, {P}, {", ".join(_COLUMNS)}, cast({L} = 'BAJA+2' as int) as positivo, cast(m.modelo as int) as modelo,
    0.5::double * floor({noise} * 100) / 100 + 0.3::double * (case when mcuentas_saldo < 0 then 1 else 0 end)
      + 0.2::double * (case when ctrx_quarter = 0 then 1 else 0 end) as score
  from labelled cross join (select unnest([{", ".join(map(str, MODELS))}]) as modelo) m where {L} is not null {where}
)"""


#: Rankings per model (and period) after `scores_sql`: position, cumulative gain and hits.
def ranked_sql(group: str = "modelo", source: str = "scores", name: str = "ranked") -> str:
    by = f"partition by {group} " if group else ""
    return f""",
{name} as (
  select s.*, row_number() over w as puesto, count(*) over g as n,
    cast(sum(case when positivo = 1 then {K.GAIN_HIT} else -{K.COST_MISS} end) over w as bigint) as ganancia,
    cast(sum(positivo) over w as bigint) as aciertos, cast(sum(positivo) over g as bigint) as positivos
  from {source} s window w as ({by}order by score desc, {E} rows between unbounded preceding and current row),
    g as ({by})
)"""


RANK_FRACTION_SQL = """,
fractions as (
  select *, (rank() over (partition by modelo order by score) + (count(*) over (partition by modelo, score) - 1) / 2.0::double)
    / count(*) over (partition by modelo) as rango from scores
)"""
