"""Queries for projection, filters and cleaning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from seriesloom.operators import cleaning as c
from seriesloom.plans import bindings as b
from seriesloom.plans.bindings import sql
from seriesloom.plans.registry import query

MEASURES_SQL = """verbete_160_operacoes_de_credito AS credito,
    verbete_161_empres_e_tit_descontados + verbete_162_financiamentos AS credito_comercial,
    verbete_163_fin_rurais_agricul_cust_invest + verbete_164_fin_rurais_pecuar_cust_invest
      + verbete_165_fin_rurais_agricul_comercializ + verbete_166_fin_rurais_pecuaria_comercializ
      + verbete_167_financiamentos_agroindustriais AS credito_rural,
    verbete_432_depositos_a_prazo + verbete_420_depositos_de_poupanca AS captacao,
    verbete_420_depositos_de_poupanca AS poupanca"""
rounded = lambda names: ", ".join(f"round({n}, 2) AS {n}" for n in names)


@query("clean_names", "SELECT c_custkey AS x_cust_key, c_name AS customer_name, c_nationkey AS nation_key, c_acctbal AS saldo_medio, c_mktsegment AS saldo_medio_2 FROM customer")
def clean_names(spark, sf):
    raw = b.table(spark, sf, "customer").toDF("#Cust Key", "customerName", "NATION-KEY", "Saldo Médio", "saldo.medio")
    return c.clean_names(raw)


@query(
    "select_matching",
    sql(
        """SELECT codmun_ibge, x_data_base, verbete_160_operacoes_de_credito, verbete_167_financiamentos_agroindustriais,
           verbete_420_depositos_de_poupanca FROM stm""",
        "stm",
    ),
)
def select_matching(spark, sf):
    wide = b.statements(spark, sf).withColumn("verbete_169_always_zero", F.lit(0.0))
    kept = c.select_matching(wide, ["16", "420", "codmun_ibge", "data"])
    return c.drop_matching(c.keep_nonzero(kept, ["x_data_base"]), "16[1-6]")


@query(
    "null_to_zero",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0.0 END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer",
)
def null_to_zero(spark, sf):
    t = b.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return c.null_to_zero(t)


@query(
    "derive_measures",
    sql(
        f"SELECT x_data_base, codmun_ibge, {rounded(c.CREDIT_MEASURES)} FROM (SELECT x_data_base, codmun_ibge, {MEASURES_SQL} FROM stm)",
        "stm",
    ),
)
def derive_measures(spark, sf):
    out = c.derive_measures(b.statements(spark, sf), c.CREDIT_MEASURES, ["x_data_base", "codmun_ibge"])
    return out.withColumns({m: F.round(m, 2) for m in c.CREDIT_MEASURES})


@query(
    "period_to_date",
    sql(
        """SELECT codmun_ibge, verbete_160_operacoes_de_credito AS credito,
           make_date(x_data_base // 100, x_data_base % 100, 1) AS data_ref FROM stm""",
        "stm",
    ),
)
def period_to_date(spark, sf):
    s = b.statements(spark, sf).select("x_data_base", "codmun_ibge", F.col("verbete_160_operacoes_de_credito").alias("credito"))
    return c.period_to_date(s, "x_data_base", "data_ref")


@query(
    "concat_columns",
    "SELECT o_orderkey, '01/' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '/' || CAST(year(o_orderdate) AS VARCHAR) AS data_ref FROM orders",
)
def concat_columns(spark, sf):
    o = b.table(spark, sf, "orders").select(
        "o_orderkey",
        F.lit("01").alias("dia"),
        F.lpad(F.month("o_orderdate").cast("string"), 2, "0").alias("mes"),
        F.year("o_orderdate").alias("ano"),
    )
    return c.unite(o, "data_ref", ["dia", "mes", "ano"], "/")


@query(
    "date_parts",
    "SELECT event_id, CAST(year(ts) AS INTEGER) AS ano, CAST(month(ts) AS INTEGER) AS mes FROM events",
)
def date_parts(spark, sf):
    return b.table(spark, sf, "events").select("event_id", F.year("ts").alias("ano"), F.month("ts").alias("mes"))


@query(
    "code_prefix",
    sql("SELECT codmun_ibge, x_data_base, substr(codmun_ibge, 1, 2) AS uf FROM stm WHERE substr(codmun_ibge, 1, 2) > '0'", "stm"),
)
def code_prefix(spark, sf):
    return c.with_region(b.statements(spark, sf).select("codmun_ibge", "x_data_base"), "codmun_ibge")


@query(
    "filter_predicates",
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
       WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus = 'F' AND o_totalprice <> 0
       AND o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '2000-12-31' AND o_custkey IS NOT NULL""",
)
def filter_predicates(spark, sf):
    o = b.table(spark, sf, "orders")
    return o.where(
        F.col("o_orderpriority").isin("1-URGENT", "5-LOW")
        & (F.col("o_orderstatus") == "F")
        & (F.col("o_totalprice") != 0)
        # typed literals, so that both bounds reach the scan
        & (F.col("o_orderdate") > F.lit(dt.datetime(1996, 1, 1)).cast("timestamp_ntz"))
        & (F.col("o_orderdate") <= F.lit(dt.datetime(2000, 12, 31)).cast("timestamp_ntz"))
        & F.col("o_custkey").isNotNull()
    ).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query(
    "drop_incomplete_tail",
    sql(
        """SELECT id, ds, y FROM padded WHERE ds <= (
             SELECT max(ds) FROM (SELECT ds, n, avg(n) OVER (ORDER BY ds ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS usual
             FROM (SELECT ds, sum(n) AS n FROM panel GROUP BY ds)) WHERE usual IS NULL OR n >= usual * 0.5)""",
        "padded",
    ),
)
def drop_incomplete_tail(spark, sf):
    volume = b.panel(spark, sf).groupBy("ds").agg(F.sum("n").alias("n"))
    return c.drop_thin_tail(b.padded(spark, sf), volume)


@query("drop_tail_months", sql("SELECT id, ds, y FROM padded WHERE ds <= (SELECT max(ds) - INTERVAL 2 MONTH FROM padded)", "padded"))
def drop_tail_months(spark, sf):
    return c.drop_tail(b.padded(spark, sf), n=2)


@query("drop_null_rows", sql("SELECT id, ds, y, rate FROM panel LEFT JOIN (SELECT * FROM rates WHERE rate >= 5) USING (ds) WHERE rate IS NOT NULL", "panel", "rates"))
def drop_null_rows(spark, sf):
    some = b.rates(spark, sf).where("rate >= 5")
    return c.drop_null_rows(b.panel(spark, sf).select("id", "ds", "y").join(some, "ds", "left").select("id", "ds", "y", "rate"))


@query(
    "rename_recode",
    sql(
        """SELECT id, model_id, CASE model_id WHEN 1 THEN 'SEASONAL NAIVE - tuned' WHEN 3 THEN 'LAST VALUE' ELSE model_desc END
           AS model_desc, ds AS index, value, 'prediction' AS key FROM fc""",
        "fc",
    ),
)
def rename_recode(spark, sf):
    named = c.relabel(b.baseline_forecasts(spark, sf), {1: "SEASONAL NAIVE - tuned", 3: "LAST VALUE"})
    return named.withColumnRenamed("ds", "index").withColumn("key", F.lit("prediction"))


@query(
    "conditional_shift",
    sql("SELECT ds, rate, round(CASE WHEN ds > DATE '2000-01-01' THEN rate + 5 ELSE rate END, 6) AS high, round(CASE WHEN ds > DATE '2000-01-01' THEN rate - 5 ELSE rate END, 6) AS low FROM rates", "rates"),
)
def conditional_shift(spark, sf):
    after = F.col("ds") > F.lit(dt.date(2000, 1, 1))
    shifted = lambda k: F.round(F.when(after, F.col("rate") + k).otherwise(F.col("rate")), 6)
    return b.rates(spark, sf).select("ds", "rate", shifted(5).alias("high"), shifted(-5).alias("low"))


@query(
    "type_coerce",
    "SELECT CAST(o_orderkey AS VARCHAR) AS order_text, CAST(o_orderdate AS DATE) AS order_day, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, CAST(o_totalprice AS DECIMAL(18,1)) AS price FROM orders",
)
def type_coerce(spark, sf):
    return b.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_text"),
        F.col("o_orderdate").cast("date").alias("order_day"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_totalprice").cast("decimal(18,1)").alias("price"),
    )


@query("row_id", sql("SELECT id, ds, y, CAST(row_number() OVER (PARTITION BY id ORDER BY ds) AS INTEGER) AS rowid FROM padded", "padded"))
def row_id(spark, sf):
    return c.with_row_id(b.padded(spark, sf))


@query(
    "calendar_grid",
    """SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month FROM
       (SELECT unnest(generate_series(min(year(o_orderdate)), max(year(o_orderdate)))) AS y FROM orders), generate_series(1, 12) t(m)""",
)
def calendar_grid(spark, sf):
    o = b.table(spark, sf, "orders")
    return c.calendar_grid(o.agg(F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year")))
