"""Ledger of experiments, submissions, their files and results, as table snapshots.

Every change takes the current snapshots and returns new ones; writing them is the caller's
step, so a failed check leaves nothing half recorded.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.session import spread

# States a submission can be in.
STATES = ("preparado", "enviado", "respondido", "fallido", "descartado")
NAME_PATTERN = r"^[A-Za-z0-9_-]+$"


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Insert new keys; for known ones take the incoming value, but keep the old where it is NULL."""
    news = incoming.select(key, *[F.col(c).alias(f"_n_{c}") for c in incoming.columns if c != key])
    merged = current.join(news, key, "full")
    return merged.select(*[
        F.col(c) if c == key or c not in incoming.columns
        else F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c)
        for c in current.columns
    ])


def _refuse(rows: DataFrame, why: str) -> None:
    first = rows.take(1)
    if first:
        raise ValueError(f"{why}: {first[0].asDict()}")


def append_submissions(submissions: DataFrame, files: DataFrame, new: DataFrame, new_files: DataFrame,
                       tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables with the new rows, or an error and no change at all.

    Names are unique and plain; files belong to a new submission and are unique inside it. `tasks` deals the names over so many
    tasks (`session.tasks_for`); the caller deals ids.
    """
    names, known = (spread(rows.select("nombre"), tasks, "nombre") for rows in (new, submissions))
    _refuse(new.filter(~F.col("nombre").rlike(NAME_PATTERN)), "name with other characters")
    _refuse(names.groupBy("nombre").count().filter("count > 1"), "name given twice")
    _refuse(names.join(known, "nombre", "left_semi"), "name already recorded")
    _refuse(new_files.groupBy("submit_id", "nombre").count().filter("count > 1"), "file given twice")
    _refuse(
        new_files.join(new.select(F.col("id").alias("submit_id")), "submit_id", "left_anti"), "file without submission"
    )
    staged = new.withColumn("estado", F.lit("preparado"))
    return (
        submissions.unionByName(staged, allowMissingColumns=True),
        files.unionByName(new_files, allowMissingColumns=True),
    )


def set_state(submissions: DataFrame, where: Column, state: str, notes: str | None = None,
              sent_at: Column | None = None) -> DataFrame:
    """Change the state of the rows that match, and with it their notes and moment of sending.

    All columns change at once, so `where` always speaks of the old row.
    """
    if state not in STATES:
        raise ValueError(f"invalid state: {state}")
    changes = {"estado": F.lit(state)}
    if notes is not None:
        changes["notas"] = F.lit(notes)
    if sent_at is not None:
        changes["enviado_en"] = sent_at
    return submissions.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in changes.items()})


def mark_sent(submissions: DataFrame, where: Column, at: Column) -> DataFrame:
    """State "enviado" and the moment of sending."""
    return set_state(submissions, where, "enviado", sent_at=at)


def record_results(submissions: DataFrame, results: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve names to ids, append one result per submission and mark those answered."""
    _refuse(new.join(submissions.select("nombre"), "nombre", "left_anti"), "no such submission")
    found = new.join(submissions.select(F.col("id").alias("submit_id"), "nombre"), "nombre")
    _refuse(found.groupBy("submit_id").count().filter("count > 1"), "two results for one submission")
    _refuse(found.join(results.select("submit_id"), "submit_id", "left_semi"), "result already recorded")
    answered = submissions.join(
        found.select(F.col("submit_id").alias("id"), F.lit(True).alias("_respondido")), "id", "left"
    )
    answered = answered.withColumn(
        "estado", F.when(F.col("_respondido"), "respondido").otherwise(F.col("estado"))
    ).select(*submissions.columns)
    return answered, results.unionByName(found.drop("nombre"), allowMissingColumns=True)


def rollup(experiments: DataFrame, submissions: DataFrame, files: DataFrame, results: DataFrame) -> DataFrame:
    """One row per submission with its experiment, result and number of files.

    Files are counted before the join, so a submission with very many files does not skew it.
    """
    counted = files.groupBy("submit_id").agg(F.count(F.lit(1)).alias("n_archivos"))
    s = submissions.withColumnRenamed("nombre", "submit")
    e = experiments.select(F.col("id").alias("experimento_id"), F.col("nombre").alias("experimento"), "corte_envios")
    r = results.select("submit_id", "public_gain_mean")
    return (
        s.join(e, "experimento_id", "left")
        .join(counted, s.id == counted.submit_id, "left").drop("submit_id")
        .join(r, s.id == r.submit_id, "left").drop("submit_id")
        .withColumn("n_archivos", F.coalesce("n_archivos", F.lit(0)).cast("long"))
    )


def listing(view: DataFrame, sent_only: bool = False) -> DataFrame:
    """Best result first, unanswered last, newest first among equals."""
    shown = view.filter(F.col("enviado_en").isNotNull()) if sent_only else view
    return shown.orderBy(F.desc_nulls_last("public_gain_mean"), F.desc("enviado_en"), "submit")


def purgeable(submissions: DataFrame, files: DataFrame, results: DataFrame, threshold: float | None = None) -> DataFrame:
    """Paths of files whose submission was discarded or scored under the threshold, unless it is final."""
    scored = submissions.join(results.select(F.col("submit_id").alias("id"), "public_gain_mean"), "id", "left")
    drop = F.col("estado") == "descartado"
    if threshold is not None:
        drop = drop | F.coalesce(F.col("public_gain_mean") < threshold, F.lit(False))
    chosen = scored.filter(~F.col("es_final") & drop).select(F.col("id").alias("submit_id"), F.col("nombre").alias("submit"))
    return files.join(chosen, "submit_id").select("submit", "ruta")


def signature(columns: Sequence[str]) -> Column:
    """First 16 hex digits of the sha256 of the columns as sorted JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16)


def config_signature(config: Mapping[str, object]) -> str:
    text = json.dumps({k: v for k, v in config.items() if k != "seed"}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def table_digest(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row count and an order-free digest of all columns and their names.

    A row's text gives each column's name and, unless it is NULL, the length and text of its value, so different
    rows have different texts. The row hashes are added up, which combines map-side; no task sees the whole table.
    """
    def told(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.concat(F.lit(f"{name}="), F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("null")), F.lit(";"))

    text = F.concat(*[told(c) for c in sorted(df.columns)])
    digest = F.sha2(text, 256)
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("filas"), F.sum(part(1)).alias("huella_1"), F.sum(part(9)).alias("huella_2")
    )


def cut_from_name(name: Column, fallback: Column) -> Column:
    """The four or five digits a name ends in, else the fallback."""
    digits = F.regexp_extract(name, r"(\d{4,5})$", 1)
    return F.when(digits != "", digits.cast("int")).otherwise(fallback.cast("int"))


def daily_counts(df: DataFrame, ts: str, shift_hours: int = 3) -> DataFrame:
    """Rows per day when the day starts `shift_hours` before midnight."""
    day = F.to_date(F.col(ts) + F.make_dt_interval(hours=F.lit(shift_hours)))
    return df.groupBy(day.alias("dia")).agg(F.count(F.lit(1)).alias("n"))


def variant_report(observations: DataFrame, group: str, variant: str, value: str, low: float | Column, high: float | Column) -> DataFrame:
    """Mean and 95 % half-width per variant, and where it lies against a reference band."""
    error = F.try_divide(F.stddev(value), F.sqrt(F.count(F.lit(1)).cast("double")))
    stats = observations.groupBy(group, variant).agg(
        F.avg(value).alias("media"), (1.96 * error).alias("ic"), F.count(F.lit(1)).alias("n")
    )
    verdict = (
        F.when(F.col("media") + F.col("ic") < low, "peor").when(F.col("media") - F.col("ic") > high, "mejor").otherwise("igual")
    )
    return stats.withColumn("veredicto", verdict)


def reconcile(ledger: DataFrame, external: DataFrame, key: str) -> DataFrame:
    """Keys that only one of the two lists holds."""
    a, b = ledger.select(key).distinct(), external.select(key).distinct()
    return (
        a.join(b, key, "left_anti").withColumn("falta_en", F.lit("externo"))
        .unionByName(b.join(a, key, "left_anti").withColumn("falta_en", F.lit("registro")))
    )
