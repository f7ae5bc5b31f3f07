"""Importance resampling towards a target distribution, by DataFrame functions alone.

Documents and target texts are bags of hashed n-grams of words. A bucket's gain is the logarithm of its smoothed share in the target over that in
the documents, a document's weight the mean gain of its n-grams, and its score the weight plus Gumbel noise that its id fixes, so the highest
scores are a sample without replacement in proportion to the weights' exponentials (in units of a thousandth).

Steps: n-gram arrays are exploded, hashed by crc32 and counted by bucket, each task sending a row a bucket at most; the gains are one row a bucket, so
their broadcast is bounded by BUCKETS; a second pass adds up each document's gains, and a row a document meets in a shuffle. Scores are sorted by range
and written once; a row's rank is its place in its partition plus the sizes of the partitions before, of which there is one number each. Ranges are split
also by the rows' numbers, so a third of all rows may have one score and one id.

Results: one row for every row of docs. A null text has no words, as an empty one; a text without n-grams weighs 0. A text of one word has that word alone.
A null doc_id counts as the empty string in the noise and is last among ties. Rows with equal ids have equal noise; among rows equal in score and id those of
fewer n-grams come first, then any order. Empty docs give no rows; an empty target has no n-grams and leaves the smoothing alone. Very long texts are
exploded as they are, row by row, never cut. Other columns are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

#: Buckets of n-grams, percent of the eligible documents that are drawn, words that make a document eligible, seed of the noise.
BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, "7"

#: What parts words, once A-Z are in lower case: ASCII that is no digit and no letter. Stated by what it is not, which the pattern engine tests faster.
APART = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def word_array(text):
    """The words of a text column, A-Z in lower case and no other letter changed; null for a null text."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, APART), "")


def bucket(gram, buckets: int):
    return (F.crc32(gram.cast("binary")) % buckets).cast("int")


def exploded(texts: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The keys and the bucket of each n-gram of text, a row for each: a row for a word and its successor, then one for each of the two n-grams that begin there.
    There is no pair at the last word, and nothing at all in a text without words: there the bucket is null."""
    words = texts.select(*keys, word_array(F.col("text")).alias("words"))
    pairs = words.select(*keys, F.inline_outer(F.arrays_zip(F.col("words").alias("w"), F.slice("words", F.lit(2), F.size("words")).alias("next"))))
    return pairs.select(*keys, F.explode(F.array(bucket(F.col("w"), buckets), bucket(F.concat("w", F.lit(" "), "next"), buckets))).alias("bucket"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: a row for each bucket, whatever the texts hold."""
    counted = lambda df, name: exploded(df.select("text"), [], buckets).filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias(name))
    every = docs.sparkSession.range(buckets).selectExpr("cast(id as int) bucket")
    # n-grams of docs and target, by bucket and in all
    n = checkpointed(every.join(counted(docs, "s"), "bucket", "left").join(counted(target, "t"), "bucket", "left").na.fill(0))
    all_s, all_t = n.agg(F.sum("s"), F.sum("t")).first()
    real = lambda x: F.expr(x).cast("double")
    ratio = (real("t + 1") * float(all_s + buckets)) / (real("s + 1") * float(all_t + buckets))
    return n.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def scored(docs: DataFrame, gains: DataFrame, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, row_no: a row for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row_no"))
    grams = exploded(rows, ["row_no", "doc_id"], buckets).join(F.broadcast(gains), "bucket", "left")
    sums = grams.groupBy("row_no", "doc_id").agg(F.count("gain").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return sums.select("doc_id", "n_features", weight.alias("weight"), (weight + noise).alias("score"), "row_no")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs; the rank of rows that are not drawn is null."""
    rows = scored(docs, bucket_gains(docs, target, buckets), buckets, seed)
    # one word more has two n-grams more
    rows = rows.withColumn("left_out", (F.col("n_features") + 1) / 2 < least_words)
    order = [F.asc("left_out"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row_no")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n_features", "weight", "score", "left_out", F.monotonically_increasing_id().alias("at"))
    placed = checkpointed(placed)  # partition and place are in the rows from here on
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("left_out"), 1)).alias("in"))
    # a row a partition
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("in").over(Window.partitionBy()).alias("eligible"))
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + place + 1)
    drawn = ~F.col("left_out") & (F.col("rank") <= F.expr(f"{percent} * eligible div 100"))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs whose id is drawn, all columns unchanged; of rows that share an id all are drawn if one is."""
    found = resample(docs, target, **how).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_drawn")), "left_semi")


#: DuckDB: the same result in SQL. The crc32 is worked out byte by byte over a table that the polynomial makes.
SQL = r"""
WITH t256 AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), texts AS (
  SELECT 0 AS kind, row_number() OVER () AS row_no, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), w AS (
  SELECT kind, row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), grams AS (
  SELECT kind, row_no, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS g FROM w
), one AS (
  SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM grams)
), hashed AS (
  SELECT g, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(x), 2), lambda k: 16 * (strpos('0123456789ABCDEF', x[k]) - 1) + strpos('0123456789ABCDEF', x[k + 1]) - 1)),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM one, t256
), hits AS (
  SELECT kind, row_no, bucket FROM grams JOIN hashed USING (g)
), n AS (
  SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM hits GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM n) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM n) + 10000)::DOUBLE)))::BIGINT AS gain FROM n
), sums AS (
  SELECT row_no, count(*) AS n_features, sum(gain)::BIGINT AS total FROM hits JOIN gains USING (bucket) WHERE kind = 0 GROUP BY row_no
), weighed AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h
  FROM texts LEFT JOIN sums USING (row_no) WHERE kind = 0
), scored AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score, n_features < 39 AS left_out FROM weighed
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY left_out, score DESC, doc_id NULLS LAST, n_features) AS r, count(*) FILTER (NOT left_out) OVER () AS eligible FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN NOT left_out AND r <= 25 * eligible // 100 THEN r END AS rank FROM ranked
"""
