"""Queries over statement files, archives and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.columns import money
from seriesloom.operators import cleaning as c
from seriesloom.operators.cleaning import CREDIT_MEASURES, null_to_zero
from seriesloom.operators.rollup import rollup_region
from seriesloom.plans import bindings as b
from seriesloom.plans import registry as checks
from seriesloom.plans import relational_plans  # noqa: F401  (its check is shared below)
from seriesloom.plans.bindings import sql
from seriesloom.plans.registry import query
from seriesloom.session import shared_folder
from seriesloom.sources import panels, statements

# Two text lines that precede the header of a statement file
PREAMBLE = ["MONTHLY STATEMENT; ALL BANKS", "AMOUNTS IN UNITS"]
TRAILER = "END OF STATEMENT"
LATE = 199801
ALONE = "verbete_167_financiamentos_agroindustriais"
MERGED = f"{ALONE}_verbete_168_rendas_a_apropriar_financ_rurais_agroindustriais"


def layouts(spark, sf):
    """Statements in two layouts: the later files name code 167 together with 168."""
    s = b.statements(spark, sf).withColumnRenamed("x_data_base", "#DATA_BASE").withColumnRenamed("codmun_ibge", "CODMUN_IBGE")
    early = s.where(F.col("#DATA_BASE") < LATE)
    late = s.where(F.col("#DATA_BASE") >= LATE).withColumnRenamed(ALONE, MERGED)
    return early, late


def lines(frame):
    """Statement text with a preamble, quoted codes, rows that end before a last amount of zero, and a trailer."""
    return statements.statement_lines(frame, PREAMBLE, quoted=["CODMUN_IBGE"], short=True, trailer=TRAILER)


def write_files(spark, sf) -> str:
    folder = shared_folder(spark)
    for name, frame in zip(("early", "late"), layouts(spark, sf)):
        lines(frame).write.text(f"{folder}/{name}")
    return folder


AMOUNTS = [c for c in b.STATEMENT_CASES if c != ALONE]
LAST = AMOUNTS[-1]
READ = {"skip": len(PREAMBLE)}
typed = lambda df, names: df.select(
    F.col("x_data_base").cast("int").alias("x_data_base"), "codmun_ibge", *[F.col(c).cast("double").alias(c) for c in names]
)


@query("src_csv_preamble", sql(f"SELECT x_data_base, codmun_ibge, {', '.join(AMOUNTS[:-1])}, nullif({LAST}, 0) AS {LAST} FROM stm", "stm"))
def src_csv_preamble(spark, sf):
    folder = write_files(spark, sf)
    return typed(statements.read_statements(spark, [f"{folder}/early", f"{folder}/late"], **READ), AMOUNTS)


@query(
    "src_rejects",
    sql(f"SELECT x_data_base < {LATE} AS early, CAST(count(*) AS BIGINT) AS n_rows, '{TRAILER}' AS rejected FROM stm GROUP BY 1", "stm"),
)
def src_rejects(spark, sf):
    """Rows that were read, and the distinct lines after the header that are none."""
    folder = write_files(spark, sf)
    parts = []
    for name in ("early", "late"):
        text = statements.read_lines(spark, f"{folder}/{name}")
        rows = statements.parse_lines(text, columns=["x_data_base"], **READ).agg(F.count("x_data_base").alias("n_rows"))
        odd = statements.rejected_lines(text, **READ).agg(F.array_join(F.sort_array(F.collect_set("line")), "|").alias("rejected"))
        parts.append(rows.select(F.lit(name == "early").alias("early"), "n_rows", odd.scalar().alias("rejected")))
    return parts[0].unionByName(parts[1])


@query(
    "src_schema_drift",
    sql(
        f"""SELECT x_data_base, codmun_ibge, CASE WHEN x_data_base < {LATE} THEN {ALONE} ELSE 0.0 END AS alone,
            CASE WHEN x_data_base >= {LATE} THEN {ALONE} ELSE 0.0 END AS merged, {ALONE} AS both
            FROM stm""",
        "stm",
    ),
)
def src_schema_drift(spark, sf):
    folder = write_files(spark, sf)
    read = statements.read_statements(spark, [f"{folder}/early", f"{folder}/late"], **READ)
    wide = null_to_zero(typed(read, [ALONE, MERGED]))
    return wide.select(
        "x_data_base", "codmun_ibge", F.col(ALONE).alias("alone"), F.col(MERGED).alias("merged"), (F.col(ALONE) + F.col(MERGED)).alias("both")
    )


@query(
    "src_zip_csv",
    sql(
        """SELECT x_data_base, CAST(count(*) AS BIGINT) AS n_rows,
           CAST(sum(CAST(verbete_160_operacoes_de_credito AS DECIMAL(18,2))) AS DOUBLE) AS credito FROM stm GROUP BY 1""",
        "stm",
    ),
)
def src_zip_csv(spark, sf):
    folder = shared_folder(spark)
    for name, frame in zip(("early", "late"), layouts(spark, sf)):
        statements.write_archives(statements.pack_archives(lines(frame)), f"{folder}/{name}")
    rows = statements.read_zipped(spark, [f"{folder}/early", f"{folder}/late"], columns=["x_data_base", "verbete_160_operacoes_de_credito"], **READ)
    return rows.groupBy(F.col("x_data_base").cast("int").alias("x_data_base")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("verbete_160_operacoes_de_credito").cast("double").cast("decimal(18,2)")).cast("double").alias("credito"),
    )


@query(
    "src_panel",
    sql("SELECT id, ds, y, n FROM panel WHERE ds >= DATE '1998-01-01'", "panel"),
)
def src_panel(spark, sf):
    path = shared_folder(spark)
    panels.write_panel(b.panel(spark, sf), path)
    return panels.read_panel(spark, path, since="1998-01-01").select("id", "ds", "y", "n")


@query("sink_panel", sql("SELECT id, ds, y, n FROM panel", "panel"))
def sink_panel(spark, sf):
    path = shared_folder(spark)
    panels.write_panel(b.panel(spark, sf), path)
    return panels.read_panel(spark, path).select("id", "ds", "y", "n")


@query("sink_forecast", sql("SELECT id, model_id, model_desc, ds, value FROM fc", "fc"))
def sink_forecast(spark, sf):
    path = shared_folder(spark)
    panels.write_forecast(b.baseline_forecasts(spark, sf), path)
    return panels.read_forecast(spark, path)


@query("ingest_clean", checks.CHECKS["rollup_region"])
def ingest_clean(spark, sf):
    """Files of two layouts to the region panel: read, clean, derive, date, roll up."""
    folder = write_files(spark, sf)
    raw = statements.read_statements(spark, [f"{folder}/early", f"{folder}/late"], **READ)
    kept = c.select_matching(raw, c.CREDIT_CODES)
    amounts = [n for n in kept.columns if n.startswith("verbete")]
    wide = null_to_zero(typed(kept, amounts))
    measures = c.derive_measures(wide, CREDIT_MEASURES, ["x_data_base", "codmun_ibge"])
    return rollup_region(money(c.period_to_date(measures, "x_data_base", "data_ref"), *CREDIT_MEASURES), "codmun_ibge", "data_ref", list(CREDIT_MEASURES))
