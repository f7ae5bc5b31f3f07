"""Queries over texts of more characters than a float counts exactly."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern import queries, queries_rules, queries_tools  # noqa: F401


@pytest.mark.parametrize("name", ["embed_worker", "http_embed"])
def test_lengths_of_very_long_texts_are_exact(spark, data, tmp_path, name):
    sizes = "CASE id WHEN 7 THEN 16777216 WHEN 10 THEN 16777217 WHEN 11 THEN 16777219 WHEN 13 THEN 33554437 ELSE 5 END"
    texts = spark.range(3, 18).selectExpr("id AS doc_id", f"CASE WHEN id <> 14 THEN repeat('ß', {sizes}) END AS text", "'de' AS lang", "'src1' AS source")
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{data}/embeddings.parquet").filter(F.col("vec_id") < 18).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert len(got) == 15 and "16777219" in {str(x) for r in got for x in r}
    assert sorted(got, key=repr) == sorted(want, key=repr)
