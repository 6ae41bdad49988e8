import zipfile

from seriesloom.operators.cleaning import snake_case
from seriesloom.sources import panels, statements

A = "REPORT\nUNITS\n#DATA_BASE;CODMUN_IBGE;VERBETE_160;VERBETE_167\n202001;35001;10.5;1\n202002;35001;;2\n"
B = "REPORT\nUNITS\n#DATA_BASE;CODMUN_IBGE;VERBETE_167_VERBETE_168;VERBETE_160\n202003;35001;5;7.5\n"


def write(tmp_path):
    (tmp_path / "a.csv").write_text(A)
    (tmp_path / "b.csv").write_text(B)


def test_layouts_are_read_by_name(spark, tmp_path):
    write(tmp_path)
    rows = statements.read_statements(spark, f"{tmp_path}/*.csv").orderBy("x_data_base").collect()
    assert [r["x_data_base"] for r in rows] == ["202001", "202002", "202003"]
    assert [r["verbete_160"] for r in rows] == ["10.5", None, "7.5"]
    assert [r["verbete_167"] for r in rows] == ["1", "2", None]
    assert [r["verbete_167_verbete_168"] for r in rows] == [None, None, "5"]


def test_archives_give_the_same_rows(spark, tmp_path):
    for name, text in (("a", A), ("b", B)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name.upper()}.CSV", text)
    rows = statements.read_zipped(spark, f"{tmp_path}/*.zip").orderBy("x_data_base").collect()
    assert [r["verbete_160"] for r in rows] == ["10.5", None, "7.5"]


def test_union_fills_missing_columns(spark):
    one = spark.createDataFrame([(1, 2.0)], "a int, code_167 double")
    two = spark.createDataFrame([(2, 3.0)], "a int, code_167_168 double")
    rows = statements.union_drift(one, two).fillna(0).orderBy("a").collect()
    assert [r["code_167"] + r["code_167_168"] for r in rows] == [2.0, 3.0]


def test_names():
    assert snake_case("#DATA_BASE") == "x_data_base"
    assert snake_case("Operações de Crédito") == "operacoes_de_credito"
    assert snake_case("customerName") == "customer_name"


def test_panel_round_trip_prunes_years(spark, tmp_path):
    from conftest import panel

    p = panel(spark, {1: range(30)})
    path = str(tmp_path / "panel")
    panels.write_panel(p, path)
    read = panels.read_panel(spark, path, since="2001-06-01")
    assert read.count() == 13
    assert "ds_year" in read._jdf.queryExecution().executedPlan().toString()


def test_a_line_is_parsed_once_whatever_is_asked_of_its_fields(spark, tmp_path):
    """Headers were parsed for each row, and a filter on a field parsed the line again."""
    write(tmp_path)
    read = statements.read_statements(spark, f"{tmp_path}/*.csv")
    kept = read.where("codmun_ibge like '35%' and verbete_160 is not null")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_csv(") == 1 and "regexp_replace" not in plan
    assert {(r["x_data_base"], r["verbete_160"]) for r in kept.collect()} == {("202001", "10.5"), ("202003", "7.5")}


def test_layouts_with_short_rows_quotes_and_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('TOP\n"#DATA_BASE";"CODMUN_IBGE";VERBETE_160\n202001;"35;1";1;surplus\n202002;35\n202003\n')
    (tmp_path / "b.csv").write_text("VERBETE_9;DATA_BASE\n")
    rows = statements.read_statements(spark, f"{tmp_path}/*.csv").orderBy("x_data_base").drop("file").collect()
    assert [tuple(r) for r in rows] == [("202001", "35;1", "1", None, None), ("202002", "35", None, None, None), ("202003", None, None, None, None)]


def test_statement_text_has_a_head_and_a_trailer_per_task(spark):
    frame = spark.range(0, 25_000, 1, 2).selectExpr("id AS code", "CAST(id % 2 AS DOUBLE) AS amount").where("code < 12500 OR code >= 100000")
    lines = [r["value"] for r in statements.statement_lines(frame, ["ONE", "TWO"], quoted=["code"], short=True, trailer="END").collect()]
    assert lines[:5] == ["ONE", "TWO", "code;amount", '"0"', '"1";1.0'] and lines[-1] == "END" and len(lines) == 12_504
