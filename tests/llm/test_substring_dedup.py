import random

from corpusloom.llm.substring_dedup import COVERS, brute_force, dedup, query


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_covers():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(query(spark, sf)) == sorted(want, key=str)
    assert any(r[2] for r in want)


def test_small_parts_and_odd_rows(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    base = [rng.choice(words) for _ in range(200)]
    texts = [(None, "a b"), (7, None), (8, ""), (9, "  \n\t "), (3, " ".join(base)), (3, " ".join(base)), (2, " ".join(base[50:])), (None, " ".join(base[:60]))]
    for k in range(10, 60):
        a = rng.randrange(170)
        texts.append((k, " ".join(rng.choice(words) for _ in range(rng.randrange(30))) + "\n" + "\t".join(base[a : a + rng.randrange(15, 40)])))
    texts.append((1, "same " * 500))
    texts.append((100, "x" * 300000 + " " + " ".join(base)))
    df = spark.createDataFrame([(i, t, "extra", 1) for i, t in texts], "doc_id long, text string, part string, n_words int")
    for size in (500, 8 << 20):
        assert rows(dedup(df, part_bytes=size, bucket_words=100)) == sorted(brute_force(texts), key=str)
    assert dedup(df.limit(0)).collect() == []
    kept = {(r.doc_id, r.n_words): r.kept for r in dedup(df, kept_text=True).collect()}
    assert kept[(9, 0)] == ""


def test_words_alike_are_told_apart(spark):
    words = [f"w{k}" for k in range(31)]
    one, two = "a", "b"
    while len(one) < 1024:
        one, two = one + two, two + one
    texts = [(1, " ".join([*words[:10], one, *words[11:]])), (2, " ".join([*words[:10], two, *words[11:]]))]
    got = rows(dedup(spark.createDataFrame(texts, "doc_id long, text string")))
    assert got == sorted(brute_force(texts), key=str) and got[1][2] == 20
