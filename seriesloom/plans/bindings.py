"""The test tables in the roles of panel, statements, rates and forecasts, in Spark and in SQL.

``id`` is the nation of the customer, ``ds`` the month of the order, ``y`` the sum of the prices.
Each SQL text is a common table expression; ``sql(...)`` puts the needed ones in front of a body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.columns import money, month_of
from seriesloom.operators.calendar import pad_calendar, split_last_n
from seriesloom.operators.ordered import extend_with_anchor, interpolate
from seriesloom.operators.rollup import conditional_sum, median_by
from seriesloom.session import stage

HOLDOUT = 12
HORIZON = 12


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_months(spark: SparkSession, sf: str) -> DataFrame:
    """Orders summed per customer and month before anything is joined, so a customer with most orders stays small."""
    orders = table(spark, sf, "orders")
    return orders.groupBy("o_custkey", month_of("o_orderdate").alias("ds")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("y"), F.count(F.lit(1)).alias("n_orders")
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """id, ds, y, n: one row per nation and month that has orders."""
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("id"))
    joined = order_months(spark, sf).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("id", "ds").agg(F.sum("y").cast("double").alias("y"), F.sum("n_orders").alias("n"))


def bounds(spark: SparkSession, sf: str) -> tuple[Column, Column]:
    """First and last order month, read from one column of the table."""
    dates = table(spark, sf, "orders").select(month_of("o_orderdate").alias("ds"))
    return dates.agg(F.min("ds")).scalar(), dates.agg(F.max("ds")).scalar()


def padded(spark: SparkSession, sf: str) -> DataFrame:
    """The panel on a full calendar, missing months as 0.

    The panel is written once: its limits and every branch of a query read it from there, and orders are scanned a single time.
    """
    return pad_calendar(stage(panel(spark, sf).select("id", "ds", "y")))


def full_months(spark: SparkSession, sf: str) -> DataFrame:
    """The padded panel, whole: its last month is reported in part and is left in, as any other month."""
    return padded(spark, sf)


def rates(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly external rate: mean discount by ship month, in percent."""
    items = table(spark, sf, "lineitem")
    return items.groupBy(month_of("l_shipdate").alias("ds")).agg(
        F.round(F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double") / F.count("l_discount") * 100, 6).alias("rate")
    )


def rates_ahead(spark: SparkSession, sf: str) -> DataFrame:
    """The rates up to the end of the horizon: their median as the anchor at its last month, interpolated up to there."""
    known = stage(rates(spark, sf).withColumn("id", F.lit(0)))
    last = table(spark, sf, "orders").select(month_of("o_orderdate").alias("ds")).agg(F.max("ds")).scalar()
    whole = extend_with_anchor(known, median_by(known, ["id"], "rate"), F.add_months(last, HORIZON))
    return interpolate(whole, "rate").select("ds", F.round("rate", 6).alias("rate"))


def baseline_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Hold-out values of three simple rules, a forecast table that SQL can rebuild.

    1 = value a year earlier, 2 = mean of the last training year, 3 = last training value.
    """
    split = split_last_n(full_months(spark, sf), HOLDOUT)
    # series of calendar length, one map per series
    train = split.where("split = 'train'").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("h")
    )
    last = F.slice("h", -HOLDOUT, HOLDOUT)
    step = F.sequence(F.lit(1), F.lit(HOLDOUT))
    mean = F.aggregate(last, F.lit(0.0), lambda s, p: s + p["y"]) / HOLDOUT
    end = F.element_at("h", -1)
    rule = lambda number, name, value: F.transform(
        step,
        lambda i: F.struct(
            F.lit(number).alias("model_id"),
            F.lit(name).alias("model_desc"),
            F.add_months(end["ds"], i).alias("ds"),
            value(i).alias("value"),
        ),
    )
    rows = F.concat(
        rule(1, "SNAIVE", lambda i: F.element_at(last, i)["y"]),
        rule(2, "MEAN", lambda i: F.round(mean, 2)),
        rule(3, "NAIVE", lambda i: end["y"]),
    )
    return train.select("id", F.inline(rows))


# Statement columns that the order table plays
STATEMENT_CASES = {
    "verbete_160_operacoes_de_credito": "true",
    "verbete_161_empres_e_tit_descontados": "o_orderpriority = '1-URGENT'",
    "verbete_162_financiamentos": "o_orderpriority = '2-HIGH'",
    "verbete_163_fin_rurais_agricul_cust_invest": "o_orderpriority = '3-MEDIUM'",
    "verbete_164_fin_rurais_pecuar_cust_invest": "o_orderpriority = '4-NOT SPECIFIED'",
    "verbete_165_fin_rurais_agricul_comercializ": "o_orderpriority = '5-LOW'",
    "verbete_166_fin_rurais_pecuaria_comercializ": "o_orderstatus = 'F'",
    "verbete_167_financiamentos_agroindustriais": "o_orderstatus = 'O'",
    "verbete_420_depositos_de_poupanca": "o_orderstatus = 'P'",
    "verbete_432_depositos_a_prazo": "o_orderpriority < '3'",
}


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as bank statements: per municipality code and period, one amount column per statement code.

    The code is the nation in two digits followed by the customer in nine.
    """
    orders = money(table(spark, sf, "orders"), "o_totalprice").withColumn("period", F.year("o_orderdate") * 100 + F.month("o_orderdate"))
    sums = orders.groupBy("o_custkey", F.col("period").alias("x_data_base")).agg(
        *conditional_sum("o_totalprice", {n: F.expr(c) for n, c in STATEMENT_CASES.items()})
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    code = F.concat(
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    )
    joined = sums.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("x_data_base", code.alias("codmun_ibge"), *STATEMENT_CASES)


MONTH = "CAST(date_trunc('month', {}) AS DATE)"

CTES = {
    "panel": (
        (),
        f"""SELECT c_nationkey AS id, {MONTH.format('o_orderdate')} AS ds,
            CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y, CAST(count(*) AS BIGINT) AS n
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    ),
    "months": (
        (),
        f"""SELECT CAST(unnest(generate_series(min({MONTH.format('o_orderdate')}), max({MONTH.format('o_orderdate')}),
            INTERVAL 1 MONTH)) AS DATE) AS ds FROM orders""",
    ),
    "padded": (
        ("panel", "months"),
        """SELECT i.id, m.ds, coalesce(p.y, 0.0) AS y FROM (SELECT DISTINCT id FROM panel) i, months m
           LEFT JOIN panel p ON p.id = i.id AND p.ds = m.ds""",
    ),
    "fullm": (("padded",), "SELECT * FROM padded"),
    "split": (
        ("fullm",),
        f"""SELECT id, ds, y, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY ds DESC) <= {HOLDOUT}
            THEN 'test' ELSE 'train' END AS split FROM fullm""",
    ),
    "rates": (
        (),
        f"""SELECT {MONTH.format('l_shipdate')} AS ds,
            round(CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(l_discount) * 100, 6) AS rate
            FROM lineitem GROUP BY 1""",
    ),
    "ratesx": (
        ("rates", "fullm"),
        f"""SELECT ds, rate FROM rates UNION ALL
            SELECT CAST(l + to_months(CAST(k AS INTEGER)) AS DATE), round(CASE WHEN k = n THEN a ELSE v + (a - v) * k / n END, 6) FROM
            (SELECT l, v, a, (year(e) - year(l)) * 12 + month(e) - month(l) AS n FROM
             (SELECT max(ds) AS l, arg_max(rate, ds) AS v, quantile_cont(rate, 0.5) AS a FROM rates),
             (SELECT CAST(max(ds) + INTERVAL {HORIZON} MONTH AS DATE) AS e FROM fullm)), LATERAL (SELECT unnest(generate_series(1, n)) AS k)""",
    ),
    "tailed": (
        ("split",),
        """SELECT *, row_number() OVER (PARTITION BY id ORDER BY ds DESC) AS r FROM split WHERE split = 'train'""",
    ),
    "fc": (
        ("split", "tailed"),
        f"""SELECT t.id, 1 AS model_id, 'SNAIVE' AS model_desc, CAST(ds + INTERVAL {HOLDOUT} MONTH AS DATE) AS ds, y AS value
            FROM tailed t WHERE r <= {HOLDOUT}
            UNION ALL
            SELECT s.id, 2, 'MEAN', s.ds, m.v FROM split s
            JOIN (SELECT id, round(CAST(sum(CAST(y AS DECIMAL(18,2))) AS DOUBLE) / {HOLDOUT}, 2) AS v FROM tailed
                  WHERE r <= {HOLDOUT} GROUP BY id) m ON m.id = s.id WHERE split = 'test'
            UNION ALL
            SELECT s.id, 3, 'NAIVE', s.ds, l.y FROM split s JOIN tailed l ON l.id = s.id AND l.r = 1 WHERE s.split = 'test'""",
    ),
    "stm": (
        (),
        "SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS x_data_base, "
        "lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS codmun_ibge, "
        + ", ".join(
            f"CAST(sum(CASE WHEN {c} THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS {n}"
            for n, c in STATEMENT_CASES.items()
        )
        + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    ),
}


def sql(body: str, *names: str, recursive: bool = False, **extra: str) -> str:
    """Put the named CTEs and what they need in front of ``body``; ``extra`` adds more, in order."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}" if parts else body
