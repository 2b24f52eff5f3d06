"""Importance resampling of documents towards a target's distribution of hashed n-grams, in Spark SQL alone.

The words of a text (``_words.MARKS``, lower-cased A-Z) give its features: runs of
1 to ``n`` words. A feature's bucket is its CRC-32 modulo ``buckets``. All
documents are counted by bucket, and all texts of the target; a bucket's gain is
1000 times the logarithm of its smoothed share in the target against that in the
documents, floored. The gain table has a row for each bucket, a parameter, so it
is broadcast; a document's weight is the floored mean of its features' gains.

Documents are drawn without replacement by the largest sums of weight and Gumbel
noise, which comes from a hash of the id. The draw is a distributed sort: rows are
dealt out to ranges of the score, sorted in these, and written; the rows of the
ranges before give the offset of a range's ranks. Texts are never shuffled, and
features only as counts: a text's features lie in one task, which adds them up.

Defined results: a null or empty text has no features, weight 0, and is not drawn;
rows with equal ids are documents each, and ties go to the smaller id, then to
fewer features, a null id (hashed as an empty text) first; an empty table gives no
row, an empty target gains from the smoothing alone; a very long text is one
array of words. Columns other than the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._shared import read_table, saved

N, BUCKETS, SEED = 1, 10_000, 2024
#: Documents of fewer words are not drawn, and of the others this many hundredths are.
LEAST_WORDS, SHARE = 20, 10
#: Rows of one range of scores.
RANGE_ROWS = 1 << 20


def words(text: str) -> Column:
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def features(column: str, n: int = N) -> Column:
    """The runs of 1 to ``n`` words of an array of words."""
    if n == 1:
        return F.col(column)
    size = F.size(column)

    def runs(m):
        starts = F.when(size >= m, F.sequence(F.lit(1), size - m + 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda k: F.array_join(F.slice(column, k, m), " "))

    return F.concat(F.col(column), *[runs(m) for m in range(2, n + 1)])


def bucket(feature: str, buckets: int = BUCKETS) -> Column:
    return F.crc32(F.col(feature).cast("binary")) % buckets


def bucket_counts(texts: DataFrame, text: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """bucket and f, the features in it."""
    rows = texts.select(words(text).alias("w")).select(F.explode(features("w", n)).alias("feature"))
    return rows.groupBy(bucket("feature", buckets).alias("bucket")).agg(F.count("*").alias("f"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain, a row for each bucket."""
    counts = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    for name, rows, column in (("s", docs, text), ("t", target, target_text)):
        counts = counts.join(bucket_counts(rows, column, n, buckets).withColumnRenamed("f", name), "bucket", "left").fillna(0, [name])
    counts = saved(counts, "buckets")
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = (F.col("t") + 1.0) * F.lit(float(total.s + buckets)) / ((F.col("s") + 1.0) * F.lit(float(total.t + buckets)))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of ``docs``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("doc_id"), words(text).alias("w"))
    # A row's features stay in its task until they are added up, so what is dealt out is a row for each document.
    each = rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.explode_outer(features("w", n)).alias("feature"))
    each = each.select("row", "doc_id", "n_words", bucket("feature", buckets).alias("bucket")).join(F.broadcast(gain), "bucket", "left")
    sums = each.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    return sums.select("doc_id", "n_words", "n_features", F.expr("(total - pmod(total, greatest(n_features, 1))) div greatest(n_features, 1)").alias("weight"))


def noise(key: str, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate, floored, from the hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``rank`` from 1 on, by ranges of ``order``; no task holds more than a range."""
    n = rows.count()
    ranges = rows.repartitionByRange(n // range_rows + 1, *order).sortWithinPartitions(*order)
    placed = saved(ranges.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    sizes = sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect())  # one row for each range
    offsets, total = [], 0
    for part, size in sizes:
        offsets.append((part, total))
        total += size
    table = rows.sparkSession.createDataFrame(offsets, "_range int, _offset long")
    return placed.join(F.broadcast(table), "_range").withColumn("rank", F.col("_offset") + F.col("_place") + 1).drop("_range", "_place", "_offset")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = N, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (of those drawn) of each row of ``docs``."""
    gain = saved(gains(docs, target, text, target_text, n, buckets), "gains")
    rows = saved(weights(docs, gain, key, text, n, buckets).withColumn("score", F.col("weight") + noise("doc_id", seed)), "weights")
    able = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features")]
    some = ranked(rows.where(able), order, range_rows)
    drawn = rows.where(able).count() * share // 100
    some = some.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return some.select(names).union(rows.where(~able).withColumn("rank", F.lit(None).cast("long")).select(names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH RECURSIVE poly AS (SELECT i, i AS c, 0 AS step FROM range(256) AS t(i)
  UNION ALL SELECT i, xor(c >> 1, (c & 1) * 3988292384), step + 1 FROM poly WHERE step < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM poly WHERE step = 8),
texts AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT side, row, unnest(w) AS word FROM w),
v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM f)),
b AS (
  SELECT word, xor(4294967295, list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda k: ('0x' || substr(h, 2 * k - 1, 2))::BIGINT),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295)) % 10000 AS bucket FROM v, tab),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN b USING (word) GROUP BY bucket),
total AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM n),
gain AS (SELECT bucket, floor(1000 * ln((n.t + 1) * (total.s + 10000) / ((n.s + 1) * (total.t + 10000))))::BIGINT AS gain FROM n, total),
sums AS (SELECT row, sum(gain)::BIGINT AS total FROM f JOIN b USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row),
d AS (
  SELECT doc_id, len(w)::BIGINT AS n_features,
    CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM w LEFT JOIN sums USING (row) WHERE side = 'd'),
scores AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
able AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS rank, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM able
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scores WHERE n_features < 20
"""
