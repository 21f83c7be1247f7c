"""Rounding at ties of the scaled double, where the decimal text of a double is below the tie: as SQL does it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pagelattice import catalog
from pagelattice.functions import text as T


def test_rounded(spark):
    values = [111.64999999999999, 27.849999999999998, 53.349999999999994, 0.05, -0.25, 2.5, 1.0, None]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = [r.y for r in df.select(T.rounded(F.col("x"), 1).alias("y")).collect()]
    con = duckdb.connect()
    assert got == [con.execute("select round(?::double, 1)", [x]).fetchone()[0] for x in values] and got[0] == 111.7


@pytest.mark.parametrize("name", ["readability_a", "readability_b"])
def test_readability_at_a_tie(spark, tmp_path, name):
    spark.createDataFrame([(1, " ".join(["ab"] * 296))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    want = con.sql(f"with documents as (select * from '{tmp_path}/documents.parquet/*.parquet') {catalog.ORACLES[name]}")
    assert got.first().grade == 111.7 and [tuple(r) for r in got.select(*want.columns).collect()] == want.fetchall()
