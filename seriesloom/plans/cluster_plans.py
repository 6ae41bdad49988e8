"""Queries for similarity and clustering: nations and customers as series, embeddings as vectors with known labels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seriesloom.functions import distances as ds
from seriesloom.functions.warping import Warping
from seriesloom.operators import calendar as cal
from seriesloom.operators import clustering as cl
from seriesloom.operators import linkage as li
from seriesloom.operators import similarity as si
from seriesloom.operators.rollup import count_by
from seriesloom.plans import bindings as b
from seriesloom.plans.bindings import sql
from seriesloom.plans.registry import query

r6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})

Z = "SELECT id, ds, (y - avg(y) OVER (PARTITION BY id)) / stddev_samp(y) OVER (PARTITION BY id) AS z, row_number() OVER (PARTITION BY id ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY id) AS n FROM fullm"


def table(spark, sf, how, **kw):
    arrays, kernel = si.feature_arrays(b.full_months(spark, sf), how, **kw)
    return r6(si.distance_table(arrays, kernel), "dist")


@query(
    "dist_euclid",
    sql("SELECT a.id AS id_a, c.id AS id_b, round(sqrt(sum((a.z - c.z) * (a.z - c.z))), 6) AS dist FROM z a JOIN z c ON c.t = a.t AND a.id < c.id GROUP BY 1, 2", "fullm", z=Z),
)
def dist_euclid(spark, sf):
    return table(spark, sf, "euclid")


@query(
    "dist_acf",
    sql(
        """SELECT a.id AS id_a, c.id AS id_b, round(sqrt(sum(0.05 * power(0.95, a.k) * (a.r - c.r) * (a.r - c.r))), 6) AS dist
           FROM rk a JOIN rk c ON c.k = a.k AND a.id < c.id GROUP BY 1, 2""",
        "fullm",
        z=Z,
        rk="""SELECT a.id, k, sum(a.z * c.z) / (any_value(a.n) - 1) AS r FROM z a, generate_series(1, 25) g(k) JOIN z c ON c.id = a.id AND c.t = a.t - k GROUP BY 1, 2""",
    ),
)
def dist_acf(spark, sf):
    return table(spark, sf, "acf")


@query(
    "dist_periodogram",
    sql(
        """SELECT a.id AS id_a, c.id AS id_b, round(sum(abs(a.f - c.f)), 6) AS dist FROM cum a JOIN cum c ON c.j = a.j AND a.id < c.id GROUP BY 1, 2""",
        "fullm",
        z=Z,
        per=f"""SELECT id, j, power(sum(z * cos({2 * math.pi!r} * j * t / n)), 2) + power(sum(z * sin({2 * math.pi!r} * j * t / n)), 2) AS p
                FROM z, generate_series(1, 500) g(j) WHERE j <= n // 2 GROUP BY 1, 2""",
        cum="SELECT id, j, sum(p) OVER (PARTITION BY id ORDER BY j) / sum(p) OVER (PARTITION BY id) AS f FROM per",
    ),
)
def dist_periodogram(spark, sf):
    return table(spark, sf, "intper")


AR2 = {
    "lagged": "SELECT id, z, lag(z, 1) OVER w AS x1, lag(z, 2) OVER w AS x2 FROM z WINDOW w AS (PARTITION BY id ORDER BY t)",
    "mom": """SELECT id, count(*) AS n, sum(x1 * x1) AS s11, sum(x2 * x2) AS s22, sum(x1 * x2) AS s12, sum(x1 * z) AS t1, sum(x2 * z) AS t2, sum(z * z) AS yy
           FROM lagged WHERE x2 IS NOT NULL GROUP BY id""",
    "fit": "SELECT *, (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) AS b1, (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) AS b2 FROM mom",
    "est": """SELECT id, b1, b2, (yy - b1 * t1 - b2 * t2) / (n - 2) * s22 / (s11 * s22 - s12 * s12) AS v11,
           (yy - b1 * t1 - b2 * t2) / (n - 2) * s11 / (s11 * s22 - s12 * s12) AS v22,
           -(yy - b1 * t1 - b2 * t2) / (n - 2) * s12 / (s11 * s22 - s12 * s12) AS v12 FROM fit""",
}
AR2_P = """exp(-((a.v22 + c.v22) * power(a.b1 - c.b1, 2) - 2 * (a.v12 + c.v12) * (a.b1 - c.b1) * (a.b2 - c.b2) + (a.v11 + c.v11) * power(a.b2 - c.b2, 2))
    / ((a.v11 + c.v11) * (a.v22 + c.v22) - power(a.v12 + c.v12, 2)) / 2)"""


@query(
    "dist_ar_pvalue",
    sql(f"SELECT a.id AS id_a, c.id AS id_b, round({AR2_P}, 6) + 0.0 AS dist FROM est a JOIN est c ON a.id < c.id", "fullm", z=Z, **AR2),
)
def dist_ar_pvalue(spark, sf):
    return table(spark, sf, "ar", order=2)


@query("dist_ar_pvalue_auto")
def dist_ar_pvalue_auto(spark, sf):
    """The order is the largest that any series' criterion picks."""
    return table(spark, sf, "ar")


@query("dist_spectral")
def dist_spectral(spark, sf):
    return table(spark, sf, "spectral", points=500)


# the recursion row by row: a row of the cost table is a list, built from left to right
DTW = {
    "z": Z,
    "arr": "SELECT id, list(z ORDER BY t) AS a FROM z GROUP BY id",
    "rows_": """SELECT a.id AS id_a, c.id AS id_b, a.a AS x, c.a AS y, 0 AS i, CAST(NULL AS DOUBLE[]) AS row_ FROM arr a JOIN arr c ON a.id < c.id
        UNION ALL SELECT id_a, id_b, x, y, i + 1, list_reduce(list_transform(range(1, len(y) + 1), lambda j: [abs(x[i + 1] - y[j]),
            CASE WHEN i = 0 THEN (CASE WHEN j = 1 THEN 0 ELSE CAST('inf' AS DOUBLE) END) WHEN j = 1 THEN row_[1] + abs(x[i + 1] - y[1])
                ELSE least(row_[j] + abs(x[i + 1] - y[j]), row_[j - 1] + 2 * abs(x[i + 1] - y[j])) END]),
            lambda acc, c: list_append(acc, CASE WHEN len(acc) = 0 THEN (CASE WHEN i = 0 THEN c[1] ELSE c[2] END) ELSE least(acc[len(acc)] + c[1], c[2]) END), CAST([] AS DOUBLE[]))
        FROM rows_ WHERE i < len(x)""",
    "dtw": "SELECT id_a, id_b, row_[len(row_)] AS d FROM rows_ WHERE i = len(x)",
}


@query("dist_dtw", sql("SELECT id_a, id_b, round(d, 6) AS dist FROM dtw", "fullm", recursive=True, **DTW))
def dist_dtw(spark, sf):
    arrays, kernel = si.dtw_arrays(b.full_months(spark, sf))
    return r6(si.distance_table(arrays, kernel), "dist")


@query(
    "dtw_nearest",
    sql(
        """SELECT id, rank, other, round(d, 6) AS dist FROM (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY d, other) AS INTEGER) AS rank, other, d FROM (
           SELECT id_a AS id, id_b AS other, d FROM dtw UNION ALL SELECT id_b, id_a, d FROM dtw)) WHERE rank <= 3""",
        "fullm",
        recursive=True,
        **DTW,
    ),
)
def dtw_nearest(spark, sf):
    """The three nearest nations of each, without the table of all pairs."""
    arrays, _ = si.dtw_arrays(b.full_months(spark, sf))
    return r6(si.nearest(arrays, Warping(), 3), "dist")


@query("dtw_within", sql("SELECT id_a, id_b, round(d, 6) AS dist FROM dtw WHERE d <= 80", "fullm", recursive=True, **DTW))
def dtw_within(spark, sf):
    arrays, _ = si.dtw_arrays(b.full_months(spark, sf))
    return r6(si.within(arrays, Warping(), 80.0), "dist")


@query("dist_dtw_window")
def dist_dtw_window(spark, sf):
    arrays, kernel = si.dtw_arrays(b.full_months(spark, sf), window=10)
    return r6(si.distance_table(arrays, kernel), "dist")


@query(
    "dist_dtw_diagonal",
    sql("SELECT a.id AS id_a, c.id AS id_b, round(sum(abs(a.z - c.z)), 6) AS dist FROM z a JOIN z c ON c.t = a.t AND a.id < c.id GROUP BY 1, 2", "fullm", z=Z),
)
def dist_dtw_diagonal(spark, sf):
    """A window of 0 leaves only the diagonal, so the distance is the sum of pointwise differences."""
    arrays, kernel = si.dtw_arrays(b.full_months(spark, sf), window=0, diagonal=1.0)
    return r6(si.distance_table(arrays, kernel), "dist")


# clusters


@query("cluster_kmedoids")
def cluster_kmedoids(spark, sf):
    arrays, kernel = si.feature_arrays(b.full_months(spark, sf), "acf")
    return r6(cl.kmedoids(arrays, 6, kernel), "dist")


@query("cluster_kmedoids_dtw")
def cluster_kmedoids_dtw(spark, sf):
    arrays, kernel = si.dtw_arrays(b.full_months(spark, sf))
    return r6(cl.kmedoids(arrays, 3, kernel, seed=235, metric=False), "dist")


@query("cluster_kmedoids_vectors")
def cluster_kmedoids_vectors(spark, sf):
    return r6(cl.kmedoids(vectors(spark, sf), 4, ds.euclid), "dist")


def vectors(spark, sf):
    e = b.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("a"), "label")


E_PAIRS = """SELECT a.vec_id AS x, c.vec_id AS y, a.label AS lx, c.label AS ly, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS d
    FROM embeddings a JOIN embeddings c ON a.vec_id < c.vec_id"""
BOTH = "SELECT x, y, lx, ly, d FROM pairs UNION ALL SELECT y, x, ly, lx, d FROM pairs"
NEAR = """SELECT v.vec_id AS id, arg_min(m.vec_id, d) AS medoid, min(d) AS d FROM embeddings v JOIN (
    SELECT e.vec_id, m.vec_id AS mid, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])) AS d FROM embeddings e, embeddings m WHERE m.vec_id < 3) x
    ON x.vec_id = v.vec_id JOIN embeddings m ON m.vec_id = x.mid GROUP BY 1"""


@query("kmedoids_assign", sql("SELECT id, CAST(medoid + 1 AS INTEGER) AS label, medoid, round(d, 6) AS dist FROM near", near=NEAR))
def kmedoids_assign(spark, sf):
    v = vectors(spark, sf)
    return r6(cl.assign(v, medoid_rows(v), ds.euclid), "dist")


def medoid_rows(v):
    # three rows
    return [(r["id"], r["a"]) for r in v.where("id < 3").orderBy("id").collect()]


@query(
    "kmedoids_update",
    sql(
        """SELECT label, arg_min(x, s) AS id FROM (SELECT n.medoid + 1 AS label, p.x, round(sum(p.d), 9) AS s FROM both_ p JOIN near n ON n.id = p.x JOIN near k ON k.id = p.y AND k.medoid = n.medoid GROUP BY 1, 2 ORDER BY 2) GROUP BY 1""",
        pairs=E_PAIRS,
        both_=BOTH,
        near=NEAR,
    ),
)
def kmedoids_update(spark, sf):
    v = vectors(spark, sf).select("id", "a")
    labels = cl.assign(v, medoid_rows(v), ds.euclid)
    moved = cl.update(v.join(labels.select("id", "label"), "id"), ds.euclid)
    return moved.select(F.col("label").cast("bigint").alias("label"), "id")


def customers(spark, sf):
    """Customers as series over all months, z-scored."""
    months = b.order_months(spark, sf).select(F.col("o_custkey").alias("id"), "ds", F.col("y").cast("double").alias("y"))
    full = cal.pad_calendar(months, bounds=b.bounds(spark, sf))
    return si.z_arrays(full)


@query("cluster_kmeans")
def cluster_kmeans(spark, sf):
    return cl.kmeans(customers(spark, sf), 3)


@query("cluster_hierarchy")
def cluster_hierarchy(spark, sf):
    return cl.bisecting(customers(spark, sf), 4)


@query("cluster_hierarchy_acf")
def cluster_hierarchy_acf(spark, sf):
    arrays, _ = si.feature_arrays(b.full_months(spark, sf), "acf")
    return cl.bisecting(arrays, 6)


@query("cluster_ward")
def cluster_ward(spark, sf):
    return li.ward(customers(spark, sf), 4)


@query("cluster_ward_heights")
def cluster_ward_heights(spark, sf):
    return li.ward_heights(customers(spark, sf))


@query("cluster_pvalue")
def cluster_pvalue(spark, sf):
    return cl.cluster_pvalue(*si.feature_arrays(b.full_months(spark, sf), "ar"), 0.6)


@query(
    "cluster_pvalue_order2",
    sql(
        "SELECT id, min(other) AS label FROM reach GROUP BY id",
        "fullm",
        recursive=True,
        z=Z,
        **AR2,
        e=f"SELECT a.id AS id_a, c.id AS id_b FROM est a JOIN est c ON a.id <> c.id WHERE {AR2_P} > 0.6",
        reach="SELECT DISTINCT id, id AS other FROM fullm UNION SELECT r.id, e.id_b FROM reach r JOIN e ON e.id_a = r.other",
    ),
)
def cluster_pvalue_order2(spark, sf):
    return cl.cluster_pvalue(*si.feature_arrays(b.full_months(spark, sf), "ar", order=2), 0.6)


CUT = 11.5


@query(
    "cluster_components",
    sql(
        "SELECT id, min(other) AS label FROM reach GROUP BY id",
        "fullm",
        recursive=True,
        z=Z,
        e=f"SELECT id_a, id_b FROM (SELECT a.id AS id_a, c.id AS id_b, round(sqrt(sum((a.z - c.z) * (a.z - c.z))), 6) AS dist FROM z a JOIN z c ON c.t = a.t AND a.id <> c.id GROUP BY 1, 2) WHERE dist < {CUT}",
        reach="SELECT DISTINCT id, id AS other FROM fullm UNION SELECT r.id, e.id_b FROM reach r JOIN e ON e.id_a = r.other",
    ),
)
def cluster_components(spark, sf):
    """Linked groups over the edges below a distance, the second half of the p-value clustering."""
    arrays, kernel = si.feature_arrays(b.full_months(spark, sf), "euclid")
    pairs = r6(si.distance_table(arrays, kernel), "dist")
    return cl.connected(pairs.where(F.col("dist") < CUT).select("id_a", "id_b"), arrays.select("id"))


@query("cluster_sync")
def cluster_sync(spark, sf):
    return cl.cluster_sync(b.full_months(spark, sf))


@query(
    "cluster_agreement",
    """WITH c AS (SELECT label AS g, vec_id % 4 AS a, count(*) AS n FROM embeddings GROUP BY 1, 2)
       SELECT round(avg(best), 6) AS agreement FROM (SELECT c.g, max(2.0 * n / (ng + na)) AS best FROM c JOIN (SELECT g, sum(n) AS ng FROM c GROUP BY 1) x ON x.g = c.g
       JOIN (SELECT a, sum(n) AS na FROM c GROUP BY 1) y ON y.a = c.a GROUP BY 1)""",
)
def cluster_agreement(spark, sf):
    v = vectors(spark, sf)
    other = v.select("id", F.pmod("id", F.lit(4)).alias("label"))
    return r6(cl.agreement(v.select("id", "label"), other), "agreement")


@query("cluster_agreement_kmeans")
def cluster_agreement_kmeans(spark, sf):
    v = vectors(spark, sf)
    k = v.agg(F.count_distinct("label")).first()[0]
    return r6(cl.agreement(v.select("id", "label"), cl.kmeans(v, k)), "agreement")


@query(
    "cluster_stats",
    sql(
        """SELECT (SELECT CAST(count(*) AS BIGINT) FROM embeddings) AS n, (SELECT CAST(count(DISTINCT label) AS BIGINT) FROM embeddings) AS clusters,
           (SELECT CAST(count(*) AS BIGINT) FROM embeddings WHERE label + 1 = 0) AS noise,
           round(max(CASE WHEN lx = ly THEN d END), 6) AS diameter, round(min(CASE WHEN lx <> ly THEN d END), 6) AS separation,
           round(avg(CASE WHEN lx = ly THEN d END), 6) AS average_within, round(avg(CASE WHEN lx <> ly THEN d END), 6) AS average_between,
           (SELECT round(avg((b - a) / greatest(a, b)), 6) FROM sil) AS silhouette,
           round(((sum(d * d) / (SELECT count(*) FROM embeddings) - (SELECT sum(w) FROM ws)) / ((SELECT count(*) FROM ws) - 1))
             / ((SELECT sum(w) FROM ws) / ((SELECT count(*) FROM embeddings) - (SELECT count(*) FROM ws))), 6) AS ch,
           round(corr(d, CASE WHEN lx <> ly THEN 1 ELSE 0 END), 6) AS pearson_gamma FROM pairs""",
        pairs=E_PAIRS,
        both_=BOTH,
        means="SELECT x, lx, ly, avg(d) AS m FROM both_ GROUP BY 1, 2, 3",
        sil="SELECT x, max(CASE WHEN lx = ly THEN m END) AS a, min(CASE WHEN lx <> ly THEN m END) AS b FROM means GROUP BY 1",
        ws="SELECT p.lx, sum(d * d) / any_value(n) AS w FROM pairs p JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) s ON s.label = p.lx WHERE lx = ly GROUP BY 1",
    ),
)
def cluster_stats(spark, sf):
    v = vectors(spark, sf).withColumn("label", F.col("label") + 1)
    out = cl.cluster_stats(si.tile_sums(v, ds.euclid), v)
    return r6(out, "diameter", "separation", "average_within", "average_between", "silhouette", "ch", "pearson_gamma")


@query(
    "cluster_profile",
    sql(
        """SELECT lx + 1 AS label, CAST(count(DISTINCT x) AS BIGINT) AS size, round(max(CASE WHEN lx = ly THEN d END), 6) AS diameter,
           round(min(CASE WHEN lx <> ly THEN d END), 6) AS separation, round(avg(CASE WHEN lx = ly THEN d END), 6) AS average_distance,
           round(avg(CASE WHEN lx <> ly THEN d END), 6) AS average_toother FROM both_ GROUP BY 1""",
        pairs=E_PAIRS,
        both_=BOTH,
    ),
)
def cluster_profile(spark, sf):
    v = vectors(spark, sf).withColumn("label", F.col("label") + 1)
    return r6(cl.cluster_profile(si.tile_sums(v, ds.euclid)), "diameter", "separation", "average_distance", "average_toother")


@query("cluster_widest_gap")
def cluster_widest_gap(spark, sf):
    return r6(cl.widest_gap(vectors(spark, sf), ds.euclid), "widest_gap")


@query(
    "cluster_info",
    sql("SELECT CAST(medoid + 1 AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS size, round(avg(d), 6) AS av_dist FROM near GROUP BY 1", near=NEAR),
)
def cluster_info(spark, sf):
    v = vectors(spark, sf)
    return r6(cl.cluster_info(cl.assign(v, medoid_rows(v), ds.euclid)), "av_dist")


@query("cluster_sizes", "SELECT label, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY 1")
def cluster_sizes(spark, sf):
    return count_by(vectors(spark, sf), "label")
