"""Queries for joins, aggregation, order, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.columns import money
from seriesloom.operators import calendar as cal
from seriesloom.operators import ordered as o
from seriesloom.operators import reshape as r
from seriesloom.operators import rollup as u
from seriesloom.operators.cleaning import CREDIT_MEASURES, derive_measures, period_to_date
from seriesloom.operators.evaluate import accuracy
from seriesloom.plans import bindings as b
from seriesloom.plans.bindings import sql
from seriesloom.plans.clean_plans import MEASURES_SQL
from seriesloom.plans.registry import query

DEC = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE) AS {1}"


# joins


@query("join_exog_inner", sql("SELECT id, ds, y, rate FROM panel JOIN rates USING (ds)", "panel", "rates"))
def join_exog_inner(spark, sf):
    return u.attach_exog(b.panel(spark, sf).select("id", "ds", "y"), b.rates(spark, sf)).select("id", "ds", "y", "rate")


@query("join_left", sql("SELECT r.ds, r.rate, k.rate AS observed FROM rates r LEFT JOIN (SELECT * FROM rates WHERE rate > 5) k ON k.ds = r.ds", "rates"))
def join_left(spark, sf):
    rates = b.rates(spark, sf)
    observed = rates.where("rate > 5").withColumnRenamed("rate", "observed")
    return u.attach_exog(rates, observed, how="left")


SHOCKS = {"base": 0.0, "pessimistic": 5.0, "optimistic": -5.0}
FUTURE_SQL = """SELECT id, CAST(last + to_months(CAST(k AS INTEGER)) AS DATE) AS ds FROM
    (SELECT id, max(ds) AS last FROM fullm GROUP BY id), generate_series(1, 12) g(k)"""
SCEN_SQL = """SELECT scenario, ds, round(CASE WHEN ds > DATE '2001-09-01' THEN rate + shock ELSE rate END, 6) AS rate
    FROM ratesx, (VALUES ('base', 0.0), ('pessimistic', 5.0), ('optimistic', -5.0)) s(scenario, shock)"""


@query(
    "join_future_scenarios",
    sql("SELECT id, ds, scenario, rate FROM ahead JOIN scen USING (ds)", "ratesx", ahead=FUTURE_SQL, scen=SCEN_SQL),
)
def join_future_scenarios(spark, sf):
    from seriesloom.operators.blend import scenario_rates

    future = cal.future_frame(b.full_months(spark, sf), b.HORIZON, bind=False)
    scen = scenario_rates(b.rates_ahead(spark, sf), "2001-09-01", SHOCKS)
    return u.attach_scenarios(future, scen).select("id", "ds", "scenario", F.round("rate", 6).alias("rate"))


@query(
    "join_future_exog",
    sql("SELECT id, ds, CAST(NULL AS DOUBLE) AS y, rate FROM ahead JOIN ratesx USING (ds)", "ratesx", ahead=FUTURE_SQL),
)
def join_future_exog(spark, sf):
    marked = cal.mark_future(b.full_months(spark, sf), b.HORIZON)
    future = u.future_keys(marked.where("split = 'future'"))
    return u.attach_exog(future, b.rates_ahead(spark, sf)).select("id", "ds", "y", "rate")


@query("uncovered_dates", sql("SELECT DISTINCT ds FROM ahead WHERE ds NOT IN (SELECT ds FROM rates)", "fullm", "rates", ahead=FUTURE_SQL))
def uncovered_dates(spark, sf):
    """Months of the horizon that the rate table does not reach."""
    return u.uncovered_dates(cal.future_frame(b.full_months(spark, sf), b.HORIZON, bind=False), b.rates(spark, sf))


@query(
    "join_group_params",
    sql(
        """SELECT id, ds, y, round(mean_log, 6) AS mean_log, round(sd_log, 6) AS sd_log FROM panel JOIN
           (SELECT id, avg(ln(1 + y)) AS mean_log, stddev_samp(ln(1 + y)) AS sd_log FROM panel GROUP BY id) USING (id)""",
        "panel",
    ),
)
def join_group_params(spark, sf):
    p = b.panel(spark, sf).select("id", "ds", "y")
    return u.attach_params(p, u.scale_params(p)).select("id", "ds", "y", F.round("mean_log", 6).alias("mean_log"), F.round("sd_log", 6).alias("sd_log"))


# aggregation


@query(
    "rollup_region",
    sql(
        f"""SELECT substr(codmun_ibge, 1, 2) AS uf, make_date(x_data_base // 100, x_data_base % 100, 1) AS data_ref,
            {', '.join(DEC.format(m, m) for m in CREDIT_MEASURES)}
            FROM (SELECT x_data_base, codmun_ibge, {MEASURES_SQL} FROM stm) WHERE substr(codmun_ibge, 1, 2) > '0' GROUP BY 1, 2""",
        "stm",
    ),
)
def rollup_region(spark, sf):
    clean = derive_measures(b.statements(spark, sf), CREDIT_MEASURES, ["x_data_base", "codmun_ibge"])
    return u.rollup_region(money(period_to_date(clean, "x_data_base", "data_ref"), *CREDIT_MEASURES), "codmun_ibge", "data_ref", list(CREDIT_MEASURES))


@query(
    "agg_municipality",
    sql(
        f"""SELECT make_date(x_data_base // 100, x_data_base % 100, 1) AS data_ref, codmun_ibge, {DEC.format('credito', 'credito')},
            {DEC.format('captacao', 'deposito')} FROM (SELECT x_data_base, codmun_ibge, {MEASURES_SQL} FROM stm) GROUP BY 1, 2""",
        "stm",
    ),
)
def agg_municipality(spark, sf):
    clean = derive_measures(b.statements(spark, sf), CREDIT_MEASURES, ["x_data_base", "codmun_ibge"])
    dated = period_to_date(clean, "x_data_base", "data_ref").withColumnRenamed("captacao", "deposito")
    return u.agg_panel(money(dated, "credito", "deposito"), ["data_ref", "codmun_ibge"], ["credito", "deposito"])


@query("agg_national", sql(f"SELECT ds, {DEC.format('y', 'y')} FROM panel GROUP BY ds", "panel"))
def agg_national(spark, sf):
    return u.agg_total(money(b.panel(spark, sf), "y"))


@query(
    "agg_forecast_total",
    sql(
        f"""SELECT ds, {DEC.format('value', 'value')} FROM (SELECT ds, y AS value FROM fullm
            UNION ALL SELECT ds, value FROM fc WHERE model_desc = 'SNAIVE') GROUP BY ds""",
        "fc",
    ),
)
def agg_forecast_total(spark, sf):
    from seriesloom.operators.evaluate import test_forecast

    both = test_forecast(b.baseline_forecasts(spark, sf), b.full_months(spark, sf))
    return u.total_forecast(money(both, "value"), ["ACTUAL", "SNAIVE"])


@query(
    "agg_median",
    "SELECT event_type, CAST(ts AS DATE) AS day, round(quantile_cont(value, 0.5), 4) AS median FROM events WHERE value IS NOT NULL GROUP BY 1, 2",
)
def agg_median(spark, sf):
    e = b.table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    return u.median_by(e, ["event_type", "day"], "value").withColumn("median", F.round("median", 4))


@query("agg_median_all", "SELECT round(quantile_cont(value, 0.5), 4) AS median FROM events")
def agg_median_all(spark, sf):
    return u.median_by(b.table(spark, sf, "events"), [], "value").withColumn("median", F.round("median", 4))


@query(
    "group_mean_sd",
    sql("SELECT id, round(avg(ln(1 + y)), 6) AS mean_log, round(stddev_samp(ln(1 + y)), 6) AS sd_log FROM panel GROUP BY id", "panel"),
)
def group_mean_sd(spark, sf):
    return u.scale_params(b.panel(spark, sf)).select("id", F.round("mean_log", 6).alias("mean_log"), F.round("sd_log", 6).alias("sd_log"))


@query(
    "agg_min_max",
    sql("SELECT min(y) AS y_min, max(y) AS y_max, min(ds) AS ds_min, max(ds) AS ds_max FROM panel", "panel"),
)
def agg_min_max(spark, sf):
    return u.range_params(b.panel(spark, sf), ["y", "ds"])


@query("count_by", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2")
def count_by(spark, sf):
    return u.count_by(b.table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("distinct_ids", sql("SELECT id, CAST(count(*) OVER () AS BIGINT) AS n_ids FROM (SELECT DISTINCT id FROM panel)", "panel"))
def distinct_ids(spark, sf):
    p = b.panel(spark, sf)
    return u.distinct_ids(p).withColumn("n_ids", p.agg(F.count_distinct("id")).scalar())


PROFILED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_missing,
            round(avg(CAST({c} AS DECIMAL(18,2))), 4) AS mean, round(stddev_samp({c}), 4) AS sd,
            {', '.join(f'round(CAST(quantile_cont({c}, {q}) AS DOUBLE), 4) AS p{int(q * 100)}' for q in (0, 0.25, 0.5, 0.75, 1.0))} FROM lineitem"""
        for c in PROFILED
    ),
)
def profile(spark, sf):
    out = u.profile(b.table(spark, sf, "lineitem"))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "p0", "p25", "p50", "p75", "p100")})


# order


EDGE_SQL = """SELECT event_type, CAST(ts AS DATE) AS period, event_id, ts, value FROM events
    QUALIFY rank() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts {}) = 1"""


def edges(spark, sf, f):
    e = b.table(spark, sf, "events")
    return f(e, F.to_date("ts"), "ts", ["event_type"]).select("event_type", "period", "event_id", "ts", "value")


@query("first_obs_per_period", EDGE_SQL.format("ASC"))
def first_obs_per_period(spark, sf):
    return edges(spark, sf, o.first_in_period)


@query("last_obs_per_period", EDGE_SQL.format("DESC"))
def last_obs_per_period(spark, sf):
    return edges(spark, sf, o.last_in_period)


@query(
    "top_k",
    sql("SELECT id, ds, y, CAST(rank() OVER (ORDER BY y DESC) AS INTEGER) AS rank FROM fullm WHERE ds = (SELECT max(ds) FROM fullm) QUALIFY rank() OVER (ORDER BY y DESC) <= 10", "fullm"),
)
def top_k(spark, sf):
    return o.top_k(o.at_latest(b.full_months(spark, sf)), 10)


@query(
    "market_share",
    sql("SELECT id, ds, y, round(y / sum(y) OVER () * 100, 1) AS share FROM fullm WHERE ds = (SELECT max(ds) FROM fullm)", "fullm"),
)
def market_share(spark, sf):
    return o.market_share(b.full_months(spark, sf))


@query(
    "reorder_category",
    sql(f"SELECT *, CAST(row_number() OVER (ORDER BY y DESC, id) AS INTEGER) AS position FROM (SELECT id, {DEC.format('y', 'y')} FROM panel GROUP BY id)", "panel"),
)
def reorder_category(spark, sf):
    return o.reorder_category(money(b.panel(spark, sf), "y"), "id", "y")


W = "PARTITION BY id ORDER BY ds"


@query("lag_features", sql(f"SELECT id, ds, y, {', '.join(f'lag(y, {k}) OVER ({W}) AS y_lag{k}' for k in range(1, 7))} FROM padded", "padded"))
def lag_features(spark, sf):
    return o.add_lags(b.padded(spark, sf), range(1, 7))


def roll_sql(column: str, k: int) -> str:
    back = (k - 1) // 2
    # both sides move the mean off exact ties before rounding
    return f"round(avg({column}) OVER ({W} ROWS BETWEEN {back} PRECEDING AND {k - 1 - back} FOLLOWING) + 1e-7, 4) AS {column}_roll{k}"


@query(
    "rolling_mean",
    sql(
        f"SELECT id, ds, y, y_lag6, {', '.join(roll_sql('y_lag6', k) for k in range(1, 7))} FROM lagged",
        "padded",
        lagged=f"SELECT *, lag(y, 6) OVER ({W}) AS y_lag6 FROM padded",
    ),
)
def rolling_mean(spark, sf):
    out = o.add_rolling(o.add_lags(b.padded(spark, sf), [6]), "y_lag6", range(1, 7))
    return out.withColumns({f"y_lag6_roll{k}": F.round(F.col(f"y_lag6_roll{k}") + 1e-7, 4) for k in range(1, 7)})


@query(
    "lag_roll_transformer",
    sql(
        f"SELECT id, ds, y, y_lag3, y_lag6, y_lag9, {', '.join(roll_sql('y_lag3', k) for k in (3, 6, 12))} FROM lagged",
        "padded",
        lagged=f"SELECT *, {', '.join(f'lag(y, {k}) OVER ({W}) AS y_lag{k}' for k in (3, 6, 9))} FROM padded",
    ),
)
def lag_roll_transformer(spark, sf):
    return o.lag_roll(b.padded(spark, sf)).withColumns({f"y_lag3_roll{k}": F.round(F.col(f"y_lag3_roll{k}") + 1e-7, 4) for k in (3, 6, 12)})


RMSE_SQL = "SELECT model_id, model_desc, round(sqrt(avg((y - value) * (y - value))), 4) AS rmse FROM fc JOIN fullm USING (id, ds) GROUP BY 1, 2"


@query("rank_models", sql("SELECT *, CAST(rank() OVER (ORDER BY rmse DESC) AS INTEGER) AS rank FROM acc", "fc", acc=RMSE_SQL))
def rank_models(spark, sf):
    acc = accuracy(b.baseline_forecasts(spark, sf), b.full_months(spark, sf))
    return o.rank_models(acc.select("model_id", "model_desc", F.round("rmse", 4).alias("rmse")))


@query("sort_accuracy", sql("SELECT * FROM acc ORDER BY rmse", "fc", acc=RMSE_SQL))
def sort_accuracy(spark, sf):
    acc = accuracy(b.baseline_forecasts(spark, sf), b.full_months(spark, sf))
    return o.sort_accuracy(acc.select("model_id", "model_desc", F.round("rmse", 4).alias("rmse")), "rmse")


@query("tail_n", sql(f"SELECT id, ds, y FROM padded QUALIFY row_number() OVER (PARTITION BY id ORDER BY ds DESC) <= 13", "padded"))
def tail_n(spark, sf):
    return o.tail_n(b.padded(spark, sf), 13)


@query("pick_series", sql("SELECT id, ds, y FROM padded WHERE id IN (3, 11)", "padded"))
def pick_series(spark, sf):
    return o.pick_series(b.padded(spark, sf), [3, 11])


GAPS = "SELECT id, ds, CASE WHEN month(ds) IN (3, 4, 5, 11) THEN NULL ELSE y END AS y FROM padded"


@query(
    "interpolate_linear",
    sql(
        f"""SELECT id, ds, round(coalesce(y, pv + (nv - pv) * (r - pr) / (nr - pr)), 4) AS y FROM (
            SELECT id, ds, y, r,
              last_value(CASE WHEN y IS NOT NULL THEN r END IGNORE NULLS) OVER prv AS pr, last_value(y IGNORE NULLS) OVER prv AS pv,
              first_value(CASE WHEN y IS NOT NULL THEN r END IGNORE NULLS) OVER nxt AS nr, first_value(y IGNORE NULLS) OVER nxt AS nv
            FROM numbered WINDOW prv AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              nxt AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        "padded",
        gaps=GAPS,
        numbered=f"SELECT *, row_number() OVER ({W}) AS r FROM gaps",
    ),
)
def interpolate_linear(spark, sf):
    gaps = b.padded(spark, sf).withColumn("y", F.when(~F.month("ds").isin(3, 4, 5, 11), F.col("y")))
    return o.interpolate(gaps, "y").withColumn("y", F.round("y", 4))


@query(
    "extend_with_anchor",
    sql(
        """SELECT id, ds, y AS rate FROM fullm UNION ALL
           SELECT id, CAST(m AS DATE), CAST(NULL AS DOUBLE) FROM (SELECT id, unnest(generate_series(last + INTERVAL 1 MONTH, DATE '2002-11-01', INTERVAL 1 MONTH)) AS m
             FROM (SELECT id, max(ds) AS last FROM fullm GROUP BY id)) UNION ALL
           SELECT id, DATE '2002-12-01', round(quantile_cont(y, 0.5), 4) FROM fullm GROUP BY id""",
        "fullm",
    ),
)
def extend_with_anchor(spark, sf):
    p = b.full_months(spark, sf).withColumnRenamed("y", "rate")
    # a median of cents has three decimals at most
    median = u.median_by(p, ["id"], "rate").withColumn("median", F.round("median", 4))
    return o.extend_with_anchor(p, median, "2002-12-01")


# sets and shapes


@query("union_rows", sql("SELECT id, ds, y, CAST(NULL AS DOUBLE) AS rate FROM panel UNION ALL SELECT CAST(NULL AS INTEGER), ds, NULL, rate FROM rates", "panel", "rates"))
def union_rows(spark, sf):
    return r.union_rows(b.panel(spark, sf).select("id", "ds", "y"), b.rates(spark, sf))


@query(
    "combine_registries",
    sql(
        """SELECT CAST(row_number() OVER (ORDER BY t, model_id) AS INTEGER) AS model_id, model_desc FROM (
           SELECT DISTINCT 0 AS t, model_id, model_desc FROM fc UNION ALL SELECT DISTINCT 1, model_id, model_desc || ' - tuned' FROM fc)""",
        "fc",
    ),
)
def combine_registries(spark, sf):
    models = b.baseline_forecasts(spark, sf).select("model_id", "model_desc").distinct()
    return r.combine_models(models, models.withColumn("model_desc", F.concat("model_desc", F.lit(" - tuned"))))


NATIONS = list(range(25))


@query("pivot_wide", sql(f"SELECT ds, {', '.join(f'max(CASE WHEN id = {i} THEN y END) AS uf_{i}' for i in NATIONS)} FROM panel GROUP BY ds", "panel"))
def pivot_wide(spark, sf):
    return r.pivot_wide(b.panel(spark, sf), "ds", "id", NATIONS, prefix="uf_")


@query(
    "melt_long",
    " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS variable, {c} AS value FROM lineitem" for c in ("l_discount", "l_quantity", "l_tax")),
)
def melt_long(spark, sf):
    wide = b.table(spark, sf, "lineitem")
    return r.melt_long(wide, ["l_orderkey", "l_linenumber"], ["l_discount", "l_quantity", "l_tax"])


@query("series_arrays", sql("SELECT id, ds, y FROM panel", "panel"))
def series_arrays(spark, sf):
    return r.from_arrays(r.to_arrays(b.panel(spark, sf), dates=True))


@query("series_nested", sql("SELECT id, array_to_string(list(CAST(CAST(y AS DECIMAL(18,2)) AS VARCHAR) ORDER BY ds), ' ') AS a FROM padded GROUP BY id", "padded"))
def series_nested(spark, sf):
    text = F.transform("a", lambda v: v.cast("decimal(18,2)").cast("string"))
    return r.to_arrays(b.padded(spark, sf)).select("id", F.array_join(text, " ").alias("a"))
