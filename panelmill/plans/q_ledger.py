"""Queries on the ledger (customers are experiments, orders submissions, lines files) and on files."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.operators import ledger as G
from panelmill.operators import ranking as R
from panelmill.plans.base import E, P
from panelmill.plans.panels import bank_panel, bank_sql
from panelmill.plans.registry import query
from panelmill.plans.scores import RANK_FRACTION_SQL, SCORED_PERIOD, scores, scores_sql
from panelmill.session import spread, tasks_for
from panelmill.sources import files as IO
from panelmill.sources.tables import table


def _cents(c):
    return F.round(F.col(c) * 100).cast("long")


def _experiments(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("nombre"), F.col("c_mktsegment").alias("target"),
        F.col("c_acctbal").alias("ganancia_val_media"), (F.col("c_nationkey") * 500 + 8000).cast("int").alias("corte_envios"),
    )


def _submissions(spark, folder):
    state = (
        F.when(F.col("o_orderstatus") == "F", "respondido").when(F.col("o_orderpriority") == "5-LOW", "descartado")
        .otherwise("enviado")
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("s_"), F.col("o_orderkey").cast("string")).alias("nombre"),
        F.col("o_custkey").alias("experimento_id"), state.alias("estado"),
        (F.col("o_orderpriority") == "1-URGENT").alias("es_final"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("enviado_en"),
    )


def _files(spark, folder):
    return _files_of(table(spark, folder, "lineitem"))


def _files_of(lines):
    """The files that line items stand for; lines are joined before, which shuffles their keys and not the texts made of them."""
    name = F.concat_ws("_", F.lit("a"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                       F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return lines.select(
        F.col("l_orderkey").alias("submit_id"), name.alias("nombre"), F.concat(F.lit("envios/"), name).alias("ruta"),
        F.col("l_quantity").cast("int").alias("n_envios"),
    )


def _results(spark, folder):
    return table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("submit_id"), F.col("o_totalprice").alias("public_gain_mean")
    )


_LEDGER = """with experimento as (select c_custkey as id, c_name as nombre, c_mktsegment as target, c_acctbal as ganancia_val_media,
    cast(c_nationkey * 500 + 8000 as int) as corte_envios from customer),
submit as (select o_orderkey as id, 's_' || o_orderkey as nombre, o_custkey as experimento_id,
    case when o_orderstatus = 'F' then 'respondido' when o_orderpriority = '5-LOW' then 'descartado' else 'enviado' end as estado,
    o_orderpriority = '1-URGENT' as es_final, case when o_orderstatus <> 'P' then o_orderdate end as enviado_en from orders),
archivo as (select l_orderkey as submit_id, 'a_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey as nombre,
    'envios/a_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey as ruta, cast(l_quantity as int) as n_envios from lineitem),
resultado as (select o_orderkey as submit_id, o_totalprice as public_gain_mean from orders where o_orderstatus = 'F')"""


@query(
    "ledger_upsert", "LG1",
    _LEDGER + """, nuevo as (select c_name as nombre, case when c_nationkey % 2 = 0 then 'REVISADO' end as target, c_acctbal + 1 as ganancia_val_media
      from customer where c_nationkey < 10)
    select e.id, e.nombre, coalesce(n.target, e.target) as target, coalesce(n.ganancia_val_media, e.ganancia_val_media) as ganancia_val_media, e.corte_envios
    from experimento e left join nuevo n on n.nombre = e.nombre""",
)
def ledger_upsert(spark, folder):
    incoming = table(spark, folder, "customer").filter("c_nationkey < 10").select(
        F.col("c_name").alias("nombre"), F.when(F.col("c_nationkey") % 2 == 0, "REVISADO").alias("target"),
        (F.col("c_acctbal") + 1).alias("ganancia_val_media"),
    )
    return G.upsert(_experiments(spark, folder), incoming, "nombre")


@query(
    "ledger_append", "LG2",
    """with nuevos as (select * from orders where year(o_orderdate) >= 2000), n as (select l_orderkey, count(*) as n from lineitem group by 1)
    select 's_' || o_orderkey as nombre, case when year(o_orderdate) >= 2000 then 'preparado' when o_orderstatus = 'F' then 'respondido'
      when o_orderpriority = '5-LOW' then 'descartado' else 'enviado' end as estado, coalesce(n, 0)::bigint as n_archivos
    from orders left join n on l_orderkey = o_orderkey""",
)
def ledger_append(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    tasks = tasks_for(spark, max(orders.count(), lines.count()))
    # the optimiser joins before it deals the lines, so the late ids are dealt as well: the join takes their tasks over
    subs, lines = _submissions(spark, folder), spread(lines, tasks, "l_orderkey")
    late = spread(orders.filter(F.year("o_orderdate") >= 2000).select(F.col("o_orderkey").alias("id")), tasks, "id")
    old, new = subs.join(late, "id", "left_anti"), subs.join(late, "id", "left_semi").drop("estado")
    late_lines = late.withColumnRenamed("id", "l_orderkey")
    all_subs, all_files = G.append_submissions(
        old, _files_of(lines.join(late_lines, "l_orderkey", "left_anti")), new, _files_of(lines.join(late_lines, "l_orderkey", "left_semi")), tasks,
    )
    counted = all_files.groupBy(F.col("submit_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return all_subs.join(counted, "id", "left").select(
        "nombre", "estado", F.coalesce("n", F.lit(0)).cast("long").alias("n_archivos")
    )


@query(
    "ledger_states", "LG3",
    _LEDGER + """ select id, nombre, experimento_id, case when estado = 'enviado' and es_final then 'fallido' else estado end as estado, es_final,
      case when estado = 'enviado' and not es_final and nombre like '%7' then timestamp '2001-12-31 00:00:00' else enviado_en end as enviado_en,
      cast(case when estado = 'enviado' and es_final then 'sin respuesta' end as varchar) as notas from submit""",
)
def ledger_states(spark, folder):
    subs = _submissions(spark, folder).withColumn("notas", F.lit(None).cast("string"))
    failed = G.set_state(subs, (F.col("estado") == "enviado") & F.col("es_final"), "fallido", "sin respuesta")
    again = (F.col("estado") == "enviado") & F.col("nombre").endswith("7")
    return G.mark_sent(failed, again, F.lit("2001-12-31 00:00:00").cast("timestamp_ntz"))


@query(
    "ledger_results", "LG4",
    _LEDGER + """, nuevo as (select o_orderkey as submit_id, o_totalprice / 2 as public_gain_mean from orders where o_orderstatus = 'O')
    select s.nombre, case when s.id in (select submit_id from nuevo) then 'respondido' else s.estado end as estado,
      coalesce(r.public_gain_mean, n.public_gain_mean) as public_gain_mean
    from submit s left join resultado r on r.submit_id = s.id left join nuevo n on n.submit_id = s.id""",
)
def ledger_results(spark, folder):
    new = table(spark, folder, "orders").filter("o_orderstatus = 'O'").select(
        F.concat(F.lit("s_"), F.col("o_orderkey").cast("string")).alias("nombre"),
        (F.col("o_totalprice") / 2).alias("public_gain_mean"),
    )
    subs, results = G.record_results(_submissions(spark, folder), _results(spark, folder), new)
    return subs.join(results.withColumnRenamed("submit_id", "id"), "id", "left").select("nombre", "estado", "public_gain_mean")


_VIEW = """, vista as (select s.id, s.nombre as submit, s.experimento_id, s.estado, s.es_final, s.enviado_en, e.nombre as experimento, e.corte_envios,
    coalesce(a.n, 0)::bigint as n_archivos, r.public_gain_mean
  from submit s left join experimento e on e.id = s.experimento_id
  left join (select submit_id, count(*) as n from archivo group by 1) a on a.submit_id = s.id
  left join resultado r on r.submit_id = s.id)"""


def _view(spark, folder):
    return G.rollup(_experiments(spark, folder), _submissions(spark, folder), _files(spark, folder), _results(spark, folder))


@query("ledger_rollup", "LG5 JN12 ST2", _LEDGER + _VIEW + " select * from vista")
def ledger_rollup(spark, folder):
    return G.listing(_view(spark, folder))


@query(
    "ledger_purge_list", "LG6",
    _LEDGER + """ select s.nombre as submit, a.ruta from submit s join archivo a on a.submit_id = s.id left join resultado r on r.submit_id = s.id
      where not s.es_final and (s.estado = 'descartado' or r.public_gain_mean < 100000)""",
)
def ledger_purge_list(spark, folder):
    return G.purgeable(_submissions(spark, folder), _files(spark, folder), _results(spark, folder), 100_000.0)


@query(
    "row_signatures", "LG7 DQ11",
    """select l_orderkey, l_linenumber, l_partkey, substr(sha256('{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey
      || ',"l_returnflag":"' || l_returnflag || '"}'), 1, 16) as firma from lineitem""",
)
def row_signatures(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", G.signature(["l_orderkey", "l_linenumber", "l_returnflag"]).alias("firma")
    )


@query(
    "table_digest", "LG7 IO14",
    f"""with t as (select *, sha256({" || ".join(
        f"'{c}=' || coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), 'null') || ';'"
        for c in ("c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey"))}) as h from customer)
    select c_nationkey, count(*) as filas, sum(('0x' || substr(h, 1, 8))::bigint)::bigint as huella_1, sum(('0x' || substr(h, 9, 8))::bigint)::bigint as huella_2
    from t group by 1""",
)
def table_digest(spark, folder):
    """Digest per nation of the whole customer table."""
    return G.table_digest(table(spark, folder, "customer"), ["c_nationkey"])


_NAMED = """with v as (select event_id, ts, case when user_id % 3 = 0 then event_type || '_c' || user_id else event_type || '_c' || user_id || '_' || (8000 + user_id * 50) end as submit,
    cast(10000 + user_id as int) as corte_envios from events)"""


@query(
    "cut_parsed_from_name", "LG8 PR13",
    _NAMED + """ select event_id, submit, cast(coalesce(nullif(regexp_extract(submit, '(\\d{4,5})$', 1), '')::int, corte_envios) as int) as corte,
      cast(ts - interval 3 hour as timestamp) as hora_local from v""",
)
def cut_parsed_from_name(spark, folder):
    base = F.concat(F.col("event_type"), F.lit("_c"), F.col("user_id").cast("string"))
    numbered = F.concat(base, F.lit("_"), (F.col("user_id") * 50 + 8000).cast("string"))
    name = F.when(F.col("user_id") % 3 == 0, base).otherwise(numbered)
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/Argentina/Buenos_Aires"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, folder, "events").select(
        "event_id", name.alias("submit"), G.cut_from_name(name, F.col("user_id") + 10000).alias("corte"), local.alias("hora_local"),
    )


@query(
    "daily_counts_shifted", "LG8",
    "select cast(ts + interval 3 hour as date) as dia, count(*) as n from events group by 1",
)
def daily_counts_shifted(spark, folder):
    return G.daily_counts(table(spark, folder, "events"), "ts", 3)


@query(
    "variant_report", "LG9 SR7",
    """with o as (select c_mktsegment as grupo, cast(c_nationkey as varchar) as variante, cast(round(o_totalprice * 100) as bigint) as v from orders join customer on c_custkey = o_custkey),
    s as (select grupo, variante, avg(v) as media, 1.96 * (stddev(v) / sqrt(count(*))) as ic, count(*) as n from o group by 1, 2)
    select grupo, variante, round(media, 4) as media, round(ic, 3) as ic, n,
      case when media + ic < 24000000 then 'peor' when media - ic > 26000000 then 'mejor' else 'igual' end as veredicto from s""",
)
def variant_report(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), _cents("o_totalprice").alias("v"))
    customer = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("grupo"), F.col("c_nationkey").cast("string").alias("variante")
    )
    report = G.variant_report(orders.join(customer, "c_custkey"), "grupo", "variante", "v", 24_000_000, 26_000_000)
    return report.withColumns({"media": F.round("media", 4), "ic": F.round("ic", 3)})


@query(
    "ledger_reconcile", "LG10 ST7",
    """with a as (select distinct o_custkey as id from orders where o_orderstatus = 'F'), b as (select distinct o_custkey as id from orders where o_orderpriority = '1-URGENT')
    select id, 'externo' as falta_en from a where id not in (select id from b) union all select id, 'registro' from b where id not in (select id from a)""",
)
def ledger_reconcile(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "id")
    return G.reconcile(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderpriority = '1-URGENT'"), "id")


# --- files ------------------------------------------------------------------------------------

_FILE_COLUMNS = ["mcuentas_saldo", "ctrx_quarter", "Visa_status"]


@query("csv_panel_round_trip", "IO1 IO5", bank_sql(_FILE_COLUMNS) + " select * from panel")
def csv_panel_round_trip(spark, folder):
    """Panel -> gzipped CSV with header -> panel, read with a schema."""
    panel, path = bank_panel(spark, folder, _FILE_COLUMNS), IO.shared_folder(spark, "panel-csv")
    IO.write_csv(panel, path, compression="gzip")
    return IO.read_csv(spark, path, panel.schema)


@query(
    "csv_inferred_types", "IO1",
    bank_sql(_FILE_COLUMNS) + f" select {E}, {P}, mcuentas_saldo, ctrx_quarter, Visa_status from panel",
)
def csv_inferred_types(spark, folder):
    """Types from a full scan; the entity arrives as a double and becomes a long."""
    path = IO.shared_folder(spark, "panel-csv")
    IO.write_csv(bank_panel(spark, folder, _FILE_COLUMNS).withColumn(E, F.col(E).cast("double")), path)
    return IO.read_csv(spark, path)


@query(
    "pushed_down_scan", "IO2 IO3 IO4 IO7",
    bank_sql(_FILE_COLUMNS) + f" select {E}, {P}, mcuentas_saldo from panel where {P} in (202105, 202106)",
)
def pushed_down_scan(spark, folder):
    """ZSTD parquet by period; a later read takes two periods and one measure from it."""
    path = IO.shared_folder(spark, "panel")
    IO.write_panel(bank_panel(spark, folder, _FILE_COLUMNS), path)
    return IO.read_panel(spark, path, ["mcuentas_saldo"], [202105, 202106])


@query(
    "score_files", "IO8 EN4 ML2",
    scores_sql() + RANK_FRACTION_SQL + f" select {E}, round(avg(rango), 9) as score from fractions group by 1",
)
def score_files(spark, folder):
    """One file per seed written, all read back at once, seeds from the names, ranks averaged."""
    path, all_scores = IO.shared_folder(spark, "scores"), scores(spark, folder)
    for seed in (1, 2, 3, 4, 5):
        IO.write_scores(all_scores.filter(F.col("modelo") == seed), path, seed, SCORED_PERIOD)
    ensemble = R.rank_ensemble(IO.read_scores(spark, path), model=["semilla"])
    return ensemble.withColumn("score", F.round("score", 9))


@query(
    "guarded_export", "IO6 JN11",
    scores_sql() + f" select {E} from scores where modelo = 1 order by score desc, {E} limit 300",
)
def guarded_export(spark, folder):
    table_, path = scores(spark, folder).filter("modelo = 1"), IO.shared_folder(spark, "seleccion")
    IO.export_selection(R.top_k(table_, 300), path, valid=table_, lowest=100, highest=15_000)
    return IO.read_selection(spark, path)


@query("multiline_text_csv", "IO9 IO10", "select conv_id, turn, role, text from conversations")
def multiline_text_csv(spark, folder):
    """Texts with quotes and line breaks through an ordered CSV export, whole and unchanged."""
    talks = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    path = IO.shared_folder(spark, "respuestas")
    IO.export_ordered(talks, path, ["conv_id", "turn"])
    return IO.read_text_csv(spark, path, talks.schema)


@query(
    "run_manifest", "IO13 DQ11 IO11",
    bank_sql(_FILE_COLUMNS) + """ select 'panel' as dataset, 'mcuentas_saldo,ctrx_quarter,Visa_status' as columnas,
      (select count(*) from panel) as filas""",
)
def run_manifest(spark, folder):
    panel, path = bank_panel(spark, folder, _FILE_COLUMNS), IO.shared_folder(spark, "manifiesto")
    IO.write_manifest(spark, path, {"dataset": "panel", "columnas": _FILE_COLUMNS, "filas": panel.count()})
    manifest = IO.read_manifest(spark, path)
    IO.require_same_features(manifest, _FILE_COLUMNS)
    return spark.read.schema("dataset string, columnas array<string>, filas long").json(path).select(
        "dataset", F.array_join("columnas", ",").alias("columnas"), "filas"
    )
