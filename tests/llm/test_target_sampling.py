import hashlib
import math
import re
import zlib

import pytest

from corpusloom.llm import target_sampling as ts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(docs, target, n=1, buckets=10000, least_words=20, share=10, seed=2024):
    def features(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[k : k + m]).encode()) % buckets for m in range(1, n + 1) for k in range(len(w) - m + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows, able = [], []
    for i, text in docs:
        size, own = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        row = [i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        rows.append(row)
        if size >= least_words:
            able.append(row)
    able.sort(key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1]))
    for rank, row in enumerate(able[: share * len(able) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, rows), key=str)


def collected(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert collected(ts.query(spark, sf)) == brute([(r.doc_id, r.text) for r in docs], [r.text for r in target])


@pytest.mark.parametrize(("n", "share", "range_rows"), [(1, 50, 1 << 20), (2, 33, 4), (3, 100, 1), (1, 0, 7)])
def test_odd_rows(spark, n, share, range_rows):
    docs = [(k, " ".join(f"W{(k * j) % 7}é" for j in range(k))) for k in range(40)] + [(None, "x y " * 20), (5, None), (6, ""), (7, "?!"), (3, "a " * 9000), (39, "a b " * 30), (39, "a b " * 30)]
    target = ["w1é w2é", None, "", "a b a b", "zz"]
    df = spark.createDataFrame([(*d, 1, "r") for d in docs], "doc_id long, text string, gain int, rank string").repartition(3)
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = ts.resample(df, bench, n=n, buckets=50, share=share, range_rows=range_rows)
    assert collected(got) == brute(docs, target, n, 50, share=share)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert ts.resample(empty, docs).collect() == []
    assert collected(ts.resample(docs, empty)) == brute([(1, "a b " * 20)], [])


def test_plan_has_no_python_and_deals_out_no_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    gain = spark.range(10).selectExpr("id AS bucket", "id AS gain")
    plan = ts.weights(docs, gain)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "BroadcastHashJoin" in plan and "partial_sum" in plan
