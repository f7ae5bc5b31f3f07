import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from lectern.llm import queries, resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)], len(words)


def slow(docs, target, buckets=10_000, percent=25, least=20):
    hashed = lambda text: [zlib.crc32(g.encode()) % buckets for g in grams(text)[0]]
    s, t = Counter(b for _, x in docs for b in hashed(x)), Counter(b for x in target for b in hashed(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    rows = []
    for i, x in docs:
        found = hashed(x)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), grams(x)[1] >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = percent * len(order) // 100
    return sorted([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(order)] + [(*r[:4], None) for r in rows if not r[4]], key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_odd_rows_against_brute_force(spark, odd_docs):
    docs = odd_docs.unionByName(odd_docs.sparkSession.createDataFrame([(1000 + k, ("Word%d common É " % k) * (k + 3), None, None, 1, "f", 1, "r", "k", "b") for k in range(40)], odd_docs.schema))
    target = spark.createDataFrame([("common É word3", 1), (None, 2), ("", 3)], "text string, bucket int")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(resampling.resample(docs, target)) == slow(rows, [r.text for r in target.collect()])
    assert got(resampling.resample(docs, target, buckets=7, percent=60, least_words=1)) == slow(rows, [r.text for r in target.collect()], 7, 60, 1)


def test_empty_tables(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "text string")
    assert got(resampling.resample(no_docs, none)) == []
    assert got(resampling.resample(odd_docs, none)) == slow([(r.doc_id, r.text) for r in odd_docs.collect()], [])


def test_one_id_and_text_in_very_many_rows_has_every_rank_once(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, id, 5) doc_id", "repeat(if(id % 3 = 0, 'a b ', 'c d '), 12) text").repartition(7)
    target = spark.createDataFrame([("c d",)], "text string")
    ranks = sorted(r.rank for r in resampling.resample(docs, target, percent=50).filter("rank is not null").collect())
    assert ranks == list(range(1, 1501))


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.range(200).selectExpr("id doc_id", "repeat(if(id % 2 = 0, 'good text ', 'bad page '), 15) text", "'x' rank", "1 score")
    found = resampling.draw(docs, spark.createDataFrame([("good text good",)] * 50, "text string"), percent=20)
    assert found.columns == docs.columns and found.count() == 40
    assert found.filter("doc_id % 2 = 0").count() > 30


def test_no_python_in_the_plan(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for df in (resampling.scored(docs, resampling.bucket_gains(docs, docs.limit(5))), resampling.exploded(docs, [], 10)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|MapIn", plan) and "CartesianProduct" not in plan


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    result = con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({resampling.SQL})").fetchall()
    assert got(queries.op12_resampling(spark, f"/root/testdata/{sf}")) == sorted(result, key=repr)
