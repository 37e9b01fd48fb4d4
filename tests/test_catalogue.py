import glob
import importlib.util
import os
import pathlib
import re
import subprocess
import sys

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__
from cardloom.functions import nid
from cardloom.plans import catalogue

SF = "/root/testdata/sf0.001"
REPO = pathlib.Path(__file__).resolve().parent.parent


def plain(rows):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_equals_duckdb(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {pathlib.Path(path).stem} AS SELECT * FROM '{path}'")
    found = db.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = catalogue.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(found.fetchall())


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n not in catalogue.oracle_sql()])
def test_others_give_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n not in ("extract_records",)])
def test_expressions_do_not_multiply(spark, name):
    """Derived columns that are used often are computed once, whatever is filtered above them."""
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.sub(r"map\(keys: .*?\]\)", "", plan)) < 30_000  # but for word lists


def test_columns_of_the_user_stay(spark):
    mine = spark.createDataFrame([("29001010100017", "a", "b", "c")], "number string, digits string, VALIDATION string, decoded string")
    (r,) = nid.with_decoded(mine, "number", F.lit("2026-01-01").cast("date")).collect()
    assert (r.digits, r.VALIDATION, r.decoded) == ("a", "b", "c") and r._digits == r.number and r._validation.valid and r._decoded.gender == "male"


def test_text_of_a_record(spark):
    row = catalogue.record_text(spark, SF).orderBy("crop").first().text.split("\n")
    assert [x[2:14].strip() for x in row[:5]] == ["Full name", "First name", "Last name", "Address", "National ID"] and any(x.startswith("  ID valid       ") for x in row)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_corpus_operators_are_optional(tmp_path, pipeline):
    """Without cardloom/llm and tests/llm the rest imports and registers its queries, with or without corpus_pipeline.py."""
    names = ["cardloom", "tests", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])]
    subprocess.run(["cp", "-r", *(str(REPO / n) for n in names if (REPO / n).exists()), str(tmp_path)], check=True)
    for k, folder in enumerate((tmp_path / "cardloom" / "llm", tmp_path / "tests" / "llm")):
        if folder.exists():
            folder.rename(tmp_path / f"gone{k}")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not any(k.startswith('op') for k in q), q; assert 'pipeline' not in q; e.oracle_sql()"
    env = os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1", "PYTEST_ADDOPTS": ""}
    for command in (["-c", code], ["-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", f"--rootdir={tmp_path}", f"--confcutdir={tmp_path}", "tests"]):
        done = subprocess.run([sys.executable, *command], cwd=tmp_path, env=env, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True)
        assert done.returncode == 0, done.stdout[-4000:]
    if importlib.util.find_spec("cardloom.llm") and importlib.util.find_spec("corpus_pipeline"):
        assert "pipeline" in __spark_entry__.queries()
