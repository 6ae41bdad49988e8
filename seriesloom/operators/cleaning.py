"""Projection, filters and cleaning of statement tables."""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the monthly bank statement and the measures summed from them.
CREDIT_MEASURES = {
    "credito": ["verbete_160_operacoes_de_credito"],
    "credito_comercial": ["verbete_161_empres_e_tit_descontados", "verbete_162_financiamentos"],
    "credito_rural": [
        "verbete_163_fin_rurais_agricul_cust_invest",
        "verbete_164_fin_rurais_pecuar_cust_invest",
        "verbete_165_fin_rurais_agricul_comercializ",
        "verbete_166_fin_rurais_pecuaria_comercializ",
        "verbete_167_financiamentos_agroindustriais_verbete_168_rendas_a_apropriar_financ_rurais_agroindustriais",
        "verbete_167_financiamentos_agroindustriais",
    ],
    "captacao": ["verbete_432_depositos_a_prazo", "verbete_420_depositos_de_poupanca"],
    "poupanca": ["verbete_420_depositos_de_poupanca"],
}
# Codes of the statement columns that are kept.
CREDIT_CODES = ["161", "162", "163", "164", "165", "166", "167", "168", "169", "160", "420", "432", "codmun_ibge", "data"]


def snake_case(name: str) -> str:
    """Lower snake case without accents; a leading symbol becomes ``x``."""
    plain = unicodedata.normalize("NFKD", name.strip()).encode("ascii", "ignore").decode()
    plain = re.sub(r"^[^0-9A-Za-z]", "x_", plain)
    plain = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", plain)
    return re.sub(r"[^0-9a-z]+", "_", plain.lower()).strip("_")


def clean_names(df: DataFrame) -> DataFrame:
    """Rename all columns to snake case; repeated names are numbered from 2."""
    seen: dict[str, int] = {}
    names = []
    for name in map(snake_case, df.columns):
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def select_matching(df: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Keep the columns whose name contains any of the codes, in the order of the codes."""
    names = dict.fromkeys(c for code in codes for c in df.columns if code.lower() in c.lower())
    return df.select(*names)


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(*[c for c in df.columns if not re.search(pattern, c)])


def keep_nonzero(df: DataFrame, always: Sequence[str] = ()) -> DataFrame:
    """Keep numeric columns that hold any value other than zero, and the columns in ``always``."""
    numeric = [c for c in numeric_columns(df) if c not in always]
    peaks = df.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in numeric]).first()
    alive = {c for c in numeric if peaks[c]}
    return df.select(*[c for c in df.columns if c in alive or c not in numeric])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def null_to_zero(df: DataFrame) -> DataFrame:
    return df.fillna(0, subset=numeric_columns(df))


def derive_measures(df: DataFrame, measures: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """One column per measure, the sum of its parts. Parts that no file has count as zero."""
    present = set(df.columns)

    def summed(parts: Sequence[str]) -> Column:
        found = [F.col(p) for p in parts if p in present]
        return sum(found[1:], found[0]) if found else F.lit(0.0)

    return df.select(*keep, *[summed(parts).alias(name) for name, parts in measures.items()])


def period_to_date(df: DataFrame, period: str, out: str = "ds") -> DataFrame:
    """Replace a YYYYMM column with the first day of that month."""
    date = F.try_to_date(F.col(period).cast("string"), "yyyyMM")
    return df.withColumn(out, date).select(*[c for c in df.columns if c != period], out)


def unite(df: DataFrame, out: str, columns: Sequence[str], sep: str = "/", remove: bool = True) -> DataFrame:
    joined = df.withColumn(out, F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]))
    return joined.drop(*columns) if remove else joined


def with_region(df: DataFrame, code: str, out: str = "uf", width: int = 2) -> DataFrame:
    """Region = leading characters of the code; rows of the unknown code 0 are dropped."""
    return df.withColumn(out, F.substring(F.col(code).cast("string"), 1, width)).where(F.col(out) > F.lit("0"))


def drop_tail(panel: DataFrame, cutoff: str | dt.date | None = None, n: int | None = None, when: str = "ds") -> DataFrame:
    """Drop the under-reported end: rows after ``cutoff``, or the last ``n`` months."""
    if cutoff is not None:
        return panel.where(F.col(when) <= F.lit(cutoff).cast("date"))
    last = panel.agg(F.max(when)).scalar()
    return panel.where(F.col(when) <= F.add_months(last, -int(n or 0)))


def drop_thin_tail(panel: DataFrame, volume: DataFrame, share: float = 0.5, window: int = 12, when: str = "ds") -> DataFrame:
    """Drop the trailing months whose volume is below a share of the trailing mean.

    ``volume`` has one row per month, ``(ds, n)``, so its window is bounded by the calendar.
    """
    before = Window.partitionBy(F.lit(1)).orderBy(when).rowsBetween(-window, -1)
    thin = volume.withColumn("_usual", F.avg("n").over(before)).withColumn(
        "_ok", F.col("_usual").isNull() | (F.col("n") >= F.col("_usual") * share)
    )
    last_ok = thin.where("_ok").agg(F.max(when)).scalar()
    return panel.where(F.col(when) <= last_ok)


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


def relabel(registry: DataFrame, labels: Mapping[int, str], key: str = "model_id", column: str = "model_desc") -> DataFrame:
    """Give some models a new description."""
    new = F.col(column)
    for model_id, text in labels.items():
        new = F.when(F.col(key) == model_id, F.lit(text)).otherwise(new)
    return registry.withColumn(column, new)


def with_row_id(panel: DataFrame, key: str = "id", when: str = "ds", out: str = "rowid") -> DataFrame:
    """Number the rows of each series by date; with the key this identifies a row of the union."""
    return panel.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(when)))


def calendar_grid(bounds: DataFrame, first: str = "first_year", last: str = "last_year") -> DataFrame:
    """All (year, month) pairs between two years given in a one-row frame."""
    years = bounds.select(F.explode(F.sequence(F.col(first), F.col(last))).alias("year"))
    return years.select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
