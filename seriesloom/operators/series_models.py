"""One model per series.

Series travel as rows with an array of values, so no group is gathered per model. Candidate
forms are exploded into rows, a task scores a batch of them, and an aggregate keeps the best:

    arrays (id, start, y, x, x_ahead) -> candidates -> scores -> min_by(aicc) per series

``start`` is the month after the last value. ``x`` holds regressors as rows over the history,
``x_ahead`` over the horizon; both are empty without regressors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import arima, kernels
from seriesloom.functions.columns import month_index

FIT = "model_id int, model_desc string, form string, aicc double, params array<double>, ahead array<double>, resid array<double>, status string, message string"
MODELS = {1: "TREND-SEASON", 2: "ARIMA", 3: "ETS", 4: "TBATS"}


def series_arrays(
    train: DataFrame,
    regressors: Sequence[str] = (),
    future: DataFrame | None = None,
    key: str = "id",
    when: str = "ds",
    value: str = "y",
    h: int | None = None,
) -> DataFrame:
    """One row per series with history and known future regressors, laid out by month.

    A month without a value between the first and the last stays NULL, and ``y`` is NULL as a whole where months repeat: the fits
    report both as errors. Future regressors cover the ``h`` months after the last value, or as many as are known;
    months that are not known are NULL.
    """
    points = F.array_sort(F.collect_list(F.struct(month_index(when).alias("t"), F.col(when).alias("ds"), F.col(value).alias("v"), *regressors)))
    nested = train.where(F.col(value).isNotNull()).groupBy(key).agg(points.alias("_p"))
    first, last = F.element_at("_p", 1)["t"], F.element_at("_p", -1)["t"]
    single = F.size(F.array_distinct("_p.t")) == F.size("_p")
    by_month = F.map_from_arrays("_p.t", "_p")
    cells = F.when(single & (last - first + 1 == F.size("_p")), F.col("_p")).when(single, F.transform(F.sequence(first, last), lambda i: F.try_element_at(by_month, i)))
    laid = nested.withColumn("_c", cells)
    x = F.array(*[F.col(f"_c.{c}") for c in regressors]) if regressors else F.array().cast("array<array<double>>")
    start = F.add_months(F.element_at("_p", -1)["ds"], 1)
    out = laid.select(F.col(key).alias("id"), start.alias("start"), F.col("_c.v").alias("y"), x.alias("x"), last.alias("_last"))
    if not regressors:
        return out.withColumn("x_ahead", F.array().cast("array<array<double>>")).drop("_last")
    rows = future.groupBy(F.col(key).alias("id"), month_index(when).alias("t")).agg(*[F.max(c).alias(c) for c in regressors])
    ahead = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct(*regressors)))).alias("_f"), F.max("t").alias("_to"))
    end = F.col("_last") + h if h else F.greatest("_to", F.col("_last") + 1)
    months = F.transform(F.sequence(F.col("_last") + 1, end), lambda i: F.try_element_at("_f", i))
    known = out.join(ahead, "id", "left").withColumn("_m", F.when(F.col("_f").isNotNull(), months))
    return known.withColumn("x_ahead", F.when(F.col("_m").isNotNull(), F.array(*[F.col(f"_m.{c}") for c in regressors]))).select("id", "start", "y", "x", "x_ahead")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread costly rows over all cores; a small input would otherwise end up in one task."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def _score(candidates: DataFrame, fit: Callable[[pd.DataFrame, int], list], model_id: int, h: int, keep: str, gaps: bool = False) -> DataFrame:
    """Score candidate rows in batches. A failing row reports its error and does not stop the others; so does a series with
    missing months, unless the model takes ``gaps``."""
    name = MODELS[model_id]
    schema = f"{keep}, {FIT}"
    carried = [c.strip().split(" ")[0] for c in keep.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 512):
                part = batch.iloc[begin : begin + 512].reset_index(drop=True)
                found = [_broken(part, i, h, gaps) for i in range(len(part))]
                sound = [i for i, problem in enumerate(found) if problem is None]
                if sound:
                    whole = part.iloc[sound].reset_index(drop=True)
                    try:
                        fits = fit(whole, h)
                    except Exception:
                        fits = [_one(fit, whole.iloc[[i]].reset_index(drop=True), h) for i in range(len(whole))]
                    for i, one in zip(sound, fits):
                        found[i] = one if isinstance(one, str) else _clean(one)
                rows = [(model_id, name, *f, "ok", None) if not isinstance(f, str) else (model_id, name, None, None, None, None, None, "error", f) for f in found]
                cols = [c.split(" ")[0] for c in FIT.split(", ")]
                scored = pd.DataFrame(rows, columns=cols)
                yield pd.concat([part[carried], scored], axis=1)

    return candidates.mapInPandas(run, schema)


def _one(fit, row: pd.DataFrame, h: int):
    try:
        return fit(row, h)[0]
    except Exception as err:
        return f"{type(err).__name__}: {err}"


def _broken(part: pd.DataFrame, i: int, h: int, gaps: bool = False) -> str | None:
    """Why a series cannot be fitted as it is, if so."""
    y = part["y"].iat[i]
    if y is None:
        return "ValueError: months repeat"
    missing = int(pd.isna(np.asarray(y, dtype=object)).sum())
    if missing and not gaps:
        return f"ValueError: {missing} months have no value; pad or interpolate the series first"
    if "x" in part and len(part["x"].iat[i]):
        ahead = part["x_ahead"].iat[i]
        if ahead is None:
            return "ValueError: no future regressors"
        known = _matrix(ahead, h)
        if known.shape[1] < h or not np.isfinite(known[:, :h]).all() or not np.isfinite(_matrix(part["x"].iat[i], len(y))).all():
            return "ValueError: regressors do not cover the history and all months of the horizon"
    return None


def _clean(found) -> tuple | str:
    form, score, params, ahead, resid = found
    if not np.all(np.isfinite(ahead)):
        return "ArithmeticError: the forecast is not finite"
    return (form, float(score) if np.isfinite(score) else kernels.PENALTY, list(map(float, params)), list(map(float, ahead)), list(map(float, resid)))


def _best(scored: DataFrame) -> DataFrame:
    """Lowest criterion per series; a series whose candidates all failed keeps one error row."""
    cols = [c.split(" ")[0] for c in FIT.split(", ")]
    size = F.coalesce(F.size("params"), F.lit(0))
    order = F.struct(F.col("status") != "ok", F.coalesce("aicc", F.lit(kernels.PENALTY)), size, F.col("params"))
    return scored.groupBy("id", "start").agg(F.min_by(F.struct(*cols), order).alias("_f")).select("id", "start", "_f.*")


def _rows(part: pd.DataFrame, column: str) -> list[np.ndarray]:
    return [np.asarray(v, dtype=float) for v in part[column]]


def _matrix(value, width: int) -> np.ndarray:
    rows = [np.asarray(v, dtype=float) for v in value]
    return np.vstack(rows) if rows else np.zeros((0, width))


def _grouped(part: pd.DataFrame, keys: list) -> Iterator[list[int]]:
    """Positions of the rows that share form and length, so that they run as one block."""
    where: dict = {}
    for i, k in enumerate(keys):
        where.setdefault(k, []).append(i)
    yield from where.values()


# exponential smoothing

PHI = (0.8, 0.9, 0.98)


def ets_forms(errors: Sequence[str] = ("A", "M")) -> Column:
    """All error, trend and season forms as an array of rows. Additive errors with a
    multiplicative season are left out, since their recursion is unstable."""
    forms = [
        F.struct(F.lit(e).alias("error"), F.lit(t).alias("trend"), F.lit(s).alias("season"), F.lit(phi).alias("phi"))
        for e in errors
        for t, phis in (("N", (1.0,)), ("A", (1.0,)), ("D", PHI))
        for phi in phis
        for s in ("N", "A", "M")
        if not (e == "A" and s == "M")
    ]
    return F.array(*forms)


def fit_ets(arrays: DataFrame, h: int, m: int = 12) -> DataFrame:
    """Exponential smoothing with error, trend and season chosen per series."""
    candidates = spread(arrays.select("id", "start", "y"), "id").select("*", F.inline(ets_forms()))
    # positive values only for multiplicative parts, two full seasons for a season
    usable = ((F.col("season") == "N") | (F.size("y") >= 2 * m + 2)) & (
        ((F.col("season") != "M") & (F.col("error") != "M")) | (F.array_min("y") > 0)
    )

    def fit(part: pd.DataFrame, h: int) -> list:
        ys = _rows(part, "y")
        keys = list(zip(part["error"], part["trend"], part["season"], part["phi"], map(len, ys)))
        out: list = [None] * len(part)
        for at in _grouped(part, keys):
            error, trend, season, phi, _ = keys[at[0]]
            for i, found in zip(at, kernels.ets_fit(np.vstack([ys[i] for i in at]), m, error, trend, season, phi, h)):
                out[i] = (f"ETS({error},{trend if trend != 'D' else 'Ad'},{season})", *found)
        return out

    keep = f"id {_type(arrays, 'id')}, start date"
    return _best(_score(candidates.where(usable), fit, 3, h, keep))


def smooth_fixed(panel: DataFrame, alphas: Sequence[float], beta: float | None = None, key: str = "id", when: str = "ds", value: str = "y") -> DataFrame:
    """Simple or linear smoothing with given parameters, folded over each series inside Spark.

    Returns the final level (and slope) and the sum of squared one-step errors per parameter.
    """
    nested = panel.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(when).alias("t"), F.col(value).alias("v")))).alias("_p"))
    rows = nested.select(key, F.col("_p.v").alias("_y"), F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))
    first = F.element_at("_y", 1)
    slope0 = (F.element_at("_y", 2) - first) if beta is not None else F.lit(0.0)
    state = F.struct(first.alias("l"), slope0.alias("b"), F.lit(0.0).alias("sse"))

    def step(s: Column, y: Column) -> Column:
        e = y - s["l"] - s["b"]
        return F.struct(
            (s["l"] + s["b"] + F.col("alpha") * e).alias("l"),
            (s["b"] + F.lit(beta or 0.0) * e).alias("b"),
            (s["sse"] + e * e).alias("sse"),
        )

    # the first value sets the level and is not scored
    folded = F.aggregate(F.slice("_y", 2, F.size("_y")), state, step)
    return rows.withColumn("_s", folded).select(key, "alpha", F.col("_s.l").alias("level"), F.col("_s.b").alias("slope"), F.col("_s.sse").alias("sse"))


# ARIMA


def fit_arima(arrays: DataFrame, h: int, m: int = 12, max_pq: int = 3, max_PQ: int = 1, refine: int = 3) -> DataFrame:
    """Seasonal ARIMA with regressors as regression with ARMA errors.

    All orders up to ``max_pq`` and ``max_PQ`` are scored by conditional least squares, each as a row; the ``refine`` best of
    a series are fitted by exact maximum likelihood, whose criterion decides. Months without a value are interpolated for
    the search and left open in the likelihood.
    """
    shape = arima.Shape(max_pq, max_PQ, m)
    orders = F.array(
        *[
            F.struct(*[F.lit(v).alias(n) for n, v in zip(("p", "q", "sp", "sq"), (p, q, sp, sq))])
            for p in range(max_pq + 1)
            for q in range(max_pq + 1)
            for sp in range(max_PQ + 1)
            for sq in range(max_PQ + 1)
        ]
    )
    candidates = spread(arrays, "id").select("*", F.inline(orders))
    long_enough = (F.col("sp") + F.col("sq") == 0) | (F.size("y") >= 3 * m)

    def search(part: pd.DataFrame, h: int) -> list:
        ys = [_filled(y) for y in _rows(part, "y")]
        needs: dict = {}
        out: list = [None] * len(part)
        plan = []
        for i, y in enumerate(ys):
            tag = (part["id"].iat[i], len(y))
            if tag not in needs:
                needs[tag] = kernels.differences(y, m)
            plan.append((*needs[tag], len(y), len(part["x"].iat[i])))
        for at in _grouped(part, plan):
            d, D, n, k = plan[at[0]]
            if n - d - D * m < 4:
                for i in at:
                    out[i] = "ValueError: series too short"
                continue
            blocks = [_levels(ys[i], part["x"].iat[i], d, D, m)[0] for i in at]
            diffed = np.stack([np.vstack([kernels.difference(r, d, D, m) for r in block]) for block in blocks])
            w, x = diffed[:, 0], diffed[:, 1:]
            active = np.array([np.r_[shape.active(*(part[c].iat[i] for c in ("p", "q", "sp", "sq"))), np.ones(x.shape[1], bool)] for i in at])
            theta, _, sse = arima.conditional_fit(w, x, active, shape)
            length = w.shape[1]
            score = kernels.aicc(length, length * np.log(sse / length + 1e-14), active.sum(axis=1) + 1)
            score = np.where(shape.unstable(theta), kernels.PENALTY, score)
            for r, i in enumerate(at):
                order = [part["p"].iat[i], d, part["q"].iat[i], part["sp"].iat[i], D, part["sq"].iat[i]]
                out[i] = ("", score[r], [*order, *theta[r, : shape.size]], [], [])
        return out

    def fit(part: pd.DataFrame, h: int) -> list:
        out: list = [None] * len(part)
        plan = []
        for i, y in enumerate(_rows(part, "y")):
            found = part["found"].iat[i]
            plan.append(None if found is None else (int(found[1]), int(found[4]), len(y), len(part["x"].iat[i]), bool(np.isnan(y).any())))
        for at in _grouped(part, plan):
            if plan[at[0]] is None:
                for i in at:
                    out[i] = part["why"].iat[i] or "ValueError: series too short"
                continue
            d, D, n, k, gaps = plan[at[0]]
            levels = [_levels(np.asarray(part["y"].iat[i], dtype=float), part["x"].iat[i], d, D, m, part["x_ahead"].iat[i], h) for i in at]
            ahead = np.stack([a for _, a in levels])
            data = np.stack([block for block, _ in levels])
            if not gaps:
                whole = np.concatenate([data[:, 1:], ahead], axis=2)
                cut = lambda block: np.stack([np.vstack([kernels.difference(r, d, D, m) for r in rows]) if len(rows) else np.zeros((0, 0)) for rows in block])
                data, ahead = cut(data), cut(whole)[:, :, -h:] if whole.shape[1] else ahead
            found = np.array([np.asarray(part["found"].iat[i], dtype=float) for i in at])
            active = np.array([shape.active(*(int(f[j]) for j in (0, 2, 3, 5))) for f in found])
            weights = arima.difference_weights(d, D, m) if gaps else np.zeros(0)
            theta, beta, deviance, used, fc, resid = arima.exact_fit(data, found[:, 6:], active, shape, weights, ahead)
            score = kernels.aicc(used, deviance, active.sum(axis=1) + beta.shape[1] + 1)
            score = np.where(shape.unstable(theta), kernels.PENALTY, score)
            for r, i in enumerate(at):
                y = np.asarray(part["y"].iat[i], dtype=float)
                scale = _scale(y)
                forecast = fc[r] if gaps else kernels.undifference(y / scale, fc[r], d, D, m)
                order = [int(v) for v in found[r, :6]]
                form = "ARIMA({},{},{})({},{},{})".format(*order) + f"[{m}]"
                out[i] = (form, score[r], [*order, *theta[r], *beta[r]], forecast * scale, resid[r] * scale)
        return out

    keep = f"id {_type(arrays, 'id')}, start date"
    searched = _score(candidates.where(long_enough), search, 2, h, keep, gaps=True)
    # a list of the candidates of one series, of which the best remain
    scored = F.when(F.col("status") == "ok", F.struct("aicc", "params"))
    top = searched.groupBy("id", "start").agg(F.slice(F.array_sort(F.collect_list(scored)), 1, refine).alias("_top"), F.max("message").alias("why"))
    same = F.col("_id").eqNullSafe(F.col("id")) & F.col("_start").eqNullSafe(F.col("start"))
    finals = arrays.join(top.withColumnsRenamed({"id": "_id", "start": "_start"}), same).select(*arrays.columns, "why", F.explode_outer("_top.params").alias("found"))
    return _best(_score(spread(finals, "id"), fit, 2, h, keep, gaps=True))


def _filled(y: np.ndarray) -> np.ndarray:
    """Missing months by straight lines; a series begins and ends with a value."""
    gap = np.isnan(y)
    return np.where(gap, np.interp(np.arange(len(y)), np.nonzero(~gap)[0], y[~gap]), y) if gap.any() else y


def _scale(y: np.ndarray) -> float:
    return float(np.nanmax(np.abs(y))) or 1.0


def _levels(y: np.ndarray, x, d: int, D: int, m: int, x_ahead=None, h: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The scaled series over its mean (or drift) and regressors, and these over the horizon."""
    mean = arima.mean_column(len(y) + h, d, D, m)
    known = np.hstack([_matrix(x, len(y)), _matrix(x_ahead, h)[:, :h]]) if h and len(x) else _matrix(x, len(y)) if len(x) else np.zeros((0, len(y) + h))
    rows = known if mean is None else np.vstack([mean[None, :], known])
    return np.vstack([(y / _scale(y))[None, :], rows[:, : len(y)]]), rows[:, len(y) :]


# trend and season


def fit_trend_season(arrays: DataFrame, h: int, m: int = 12) -> DataFrame:
    """Piecewise linear trend, yearly Fourier terms and regressors by ridge regression."""

    def fit(part: pd.DataFrame, h: int) -> list:
        out = []
        for y, x, known in zip(_rows(part, "y"), part["x"], part["x_ahead"]):
            if len(y) < 2:
                out.append("ValueError: series too short")
                continue
            ahead, steps = _matrix(known, h)[:, :h], h
            both = np.hstack([_matrix(x, len(y)), ahead]) if len(x) else np.zeros((0, len(y) + h))
            fc, resid, beta = kernels.trend_season_fit(y, both, steps, m)
            deviance = len(y) * np.log(float(resid @ resid) / len(y) + 1e-12)
            out.append(("TREND-SEASON" + (" W/ REGRESSORS" if len(x) else ""), deviance, beta, fc, resid))
        return out

    keep = f"id {_type(arrays, 'id')}, start date"
    return _score(spread(arrays, "id"), fit, 1, h, keep)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


# trigonometric season with Box-Cox and ARMA errors


def fit_tbats(arrays: DataFrame, h: int, m: int = 12, max_k: int = 4) -> DataFrame:
    """Box-Cox, damped trend, trigonometric season and ARMA(1,1) errors; options chosen by the criterion."""
    options = F.array(
        *[
            F.struct(F.lit(lam).alias("lam"), F.lit(phi).alias("phi"), F.lit(k).alias("k"), F.lit(arma).alias("arma"))
            for lam in (0.0, 0.5, 1.0)
            for phi in (0.0, 0.9, 1.0)
            for k in range(max_k + 1)
            for arma in (False, True)
        ]
    )
    candidates = spread(arrays.select("id", "start", "y"), "id").select("*", F.inline(options))
    usable = ((F.col("k") == 0) | (F.size("y") >= 2 * m)) & ((F.col("lam") == 1.0) | (F.array_min("y") > 0))

    def fit(part: pd.DataFrame, h: int) -> list:
        ys = _rows(part, "y")
        keys = list(zip(part["lam"], part["phi"], part["k"], part["arma"], map(len, ys)))
        out: list = [None] * len(part)
        for at in _grouped(part, keys):
            lam, phi, k, arma, _ = keys[at[0]]
            form = f"TBATS({lam:g}, {{{int(arma)},{int(arma)}}}, {phi if phi else '-'}, {{<{m},{k}>}})"
            for i, found in zip(at, kernels.tbats_fit(np.vstack([ys[i] for i in at]), m, lam, phi, k, arma, h)):
                out[i] = (form, *found)
        return out

    keep = f"id {_type(arrays, 'id')}, start date"
    return _best(_score(candidates.where(usable), fit, 4, h, keep))


# shared


FAMILIES: dict[str, tuple[int, Callable]] = {
    "trend_season": (1, fit_trend_season),
    "arima": (2, fit_arima),
    "ets": (3, fit_ets),
    "tbats": (4, fit_tbats),
}


def nested_fit(arrays: DataFrame, models: Sequence[str] = ("trend_season", "arima", "ets"), h: int = 12, chosen: DataFrame | None = None) -> DataFrame:
    """Fit several models to every series, with the error of each failed fit.

    ``chosen`` (id, model_id) limits the fits to given pairs, as for a refit of the winners. A winner that is
    no model of this list is an ensemble: its members are all fitted again and averaged.
    """
    fits = None
    if chosen is not None:
        families = [FAMILIES[name][0] for name in models]
        blended = chosen.where(~F.col("model_id").isin(families)).select("id", F.col("model_id").alias("_model"))
        members = nested_fit(arrays.join(blended.select("id").distinct(), "id", "left_semi"), models, h)
        fits = blend_fits(members).join(blended, "id").withColumn("model_id", F.col("_model").cast("int")).drop("_model")
    for name in models:
        model_id, fit = FAMILIES[name]
        todo = arrays
        if chosen is not None:
            todo = arrays.join(chosen.where(F.col("model_id") == model_id).select("id"), "id", "left_semi")
        one = fit(todo, h)
        fits = one if fits is None else fits.unionByName(one)
    return fits


def blend_fits(fits: DataFrame) -> DataFrame:
    """The mean of each series' fitted models as a fit of its own; it fails only where all of them have failed."""
    # a row per model and series: the lists hold a few arrays
    fine = F.col("status") == "ok"
    lists = fits.groupBy("id", "start").agg(*[F.collect_list(F.when(fine, F.col(c))).alias(c) for c in ("ahead", "resid")], F.max("message").alias("_why"))
    n = F.size("ahead")
    mean = lambda c, size: F.transform(F.sequence(F.lit(1), size), lambda i: F.aggregate(c, F.lit(0.0), lambda s, a: s + F.element_at(a, i - size - 1)) / n)
    shortest = lambda c: F.array_min(F.transform(c, F.size))
    done = n > 0
    return lists.select(
        "id", "start", F.lit(100).alias("model_id"), F.lit("ENSEMBLE (MEAN)").alias("model_desc"), F.when(done, F.lit("ENSEMBLE (MEAN)")).alias("form"),
        F.lit(None).cast("double").alias("aicc"), F.when(done, F.array().cast("array<double>")).alias("params"),
        F.when(done, mean("ahead", shortest("ahead"))).alias("ahead"), F.when(done, mean("resid", shortest("resid"))).alias("resid"),
        F.when(done, "ok").otherwise("error").alias("status"), F.when(~done, F.col("_why")).alias("message"),
    )


def error_report(fits: DataFrame) -> DataFrame:
    """Which fits failed and why."""
    return fits.where("status = 'error'").select("id", "model_id", "model_desc", "message")


def forecast_rows(fits: DataFrame) -> DataFrame:
    """Forecast values as rows."""
    return fits.where("status = 'ok'").select("id", "start", "model_id", "model_desc", F.posexplode("ahead").alias("_k", "value")).select(
        "id", "model_id", "model_desc", F.add_months("start", F.col("_k")).alias("ds"), "value"
    )


def residual_rows(fits: DataFrame) -> DataFrame:
    """One-step errors of the training rows; they end the month before the forecast starts."""
    done = fits.where("status = 'ok'").select("id", "start", "model_id", F.size("resid").alias("_n"), F.posexplode("resid").alias("_k", "resid"))
    # months without a value have no error
    return done.where(F.col("resid").isNotNull() & ~F.isnan("resid")).select("id", "model_id", F.add_months("start", F.col("_k") - F.col("_n")).alias("ds"), "resid")
