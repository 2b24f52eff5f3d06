import zlib

import numpy as np

from corpusloom.llm.quality import NAMES, RIDGE, SHRINKAGE, fit, keep_good, model_of, query, score, statistics, with_statistics


def rows(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    return docs, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_against_densities_by_hand(spark, sf):
    docs, labels = rows(spark, sf)
    got = {r.doc_id: r for r in query(spark, sf).collect()}
    assert set(got) == set(docs) and all(r.held_out == held(i) for i, r in got.items())
    x = {i: statistics([(t or "").encode()])[0] for i, t in docs.items()}
    known = {k: np.array([x[i] for i, q in labels if q == k and not held(i)]) for k in (0, 1)}
    n = sum(map(len, known.values()))
    pooled = np.diag(sum(len(v) * np.var(v, axis=0) for v in known.values()) / n)
    density = {}
    for k, v in known.items():
        cov = (1 - SHRINKAGE) * np.cov(v.T, bias=True) + SHRINKAGE * pooled + RIDGE * np.eye(len(NAMES))
        inverse, det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        density[k] = lambda y, m=v.mean(axis=0), a=inverse, d=det, p=len(v) / n: np.log(p) - 0.5 * (d + (y - m) @ a @ (y - m))
    for i, r in got.items():
        want = 1 / (1 + np.exp(np.clip(density[0](x[i]) - density[1](x[i]), -700, 700)))
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r.predicted for r in query(spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if held(r.doc_id)]
    assert np.mean([got[i] == q for i, q in labels]) > 0.97
    assert np.mean([got[i] for i, q in labels if q == 1]) > 0.98


def test_odd_rows(spark):
    texts = [(1, "Plain words in a row, as they are."), (2, None), (3, ""), (3, ""), (None, "x"), (4, "%%% " * 100000), (5, "é ü"), (6, "\n\n \t")]
    df = spark.createDataFrame([(i, t, 5.0) for i, t in texts], "doc_id long, text string, stats double")
    stats = with_statistics(df)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = fit(stats, none)
    assert {r.score for r in score(stats, model).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 1), (4, 0), (4, 0), (6, 0), (6, 5)], "doc_id long, quality int")
    got = score(stats, fit(stats, labels)).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got) and not [r for r in got if r.doc_id is None][0].held_out
    kept = keep_good(df, labels)
    assert kept.columns == df.columns and 4 not in {r.doc_id for r in kept.collect()}
    assert score(with_statistics(df.limit(0)), model).collect() == []
    assert model_of({}).scores(np.zeros((2, len(NAMES)))).tolist() == [0.5, 0.5]


def test_labels_are_no_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same = docs.withColumn("lang", docs.source).withColumn("n_chars", docs.doc_id)
    a, b = ([tuple(r.stats) for r in with_statistics(d).orderBy("doc_id").collect()] for d in (docs, same))
    assert a == b
