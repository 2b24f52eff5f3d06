import random

from corpusloom.llm.jaccard_join import brute_force, join, keep_one, least_matches, query


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(query(spark, sf)) == sorted(want, key=str)
    assert any(r[2] for r in want)


def _texts(n=140):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(300)]
    out = [(None, "one two"), (1, "One, TWO!"), (2, None), (3, ""), (4, "?? !!"), (5, "one two three"), (5, "one two three")]
    for k in range(10, n):
        own = list(base[: rng.choice([300, 280, 250])])
        for _ in range(rng.randrange(12)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append((k, " ".join(own)))
    for k in range(n, n + 30):
        out.append((k, " ".join(rng.choice(words) for _ in range(60)) + " " + " ".join(base[:15])))
    return out + [(n + 100, "z" * 200000), (n + 101, "same " * 3000)]


def test_groups_and_odd_rows(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, root string")
    want = sorted(brute_force(texts), key=str)
    assert rows(join(df, part_bytes=20000)) == want
    assert rows(join(df, block_rows=40, block_bytes=50000)) == want
    assert join(df.limit(0)).collect() == []
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({w[1] for w in want if w[1] is not None})


def test_pruning_bounds():
    need = least_matches(0.8)
    assert need == sorted(need) and 0 < need[-1] < 128 * 0.8


def _doubled(n, first="a", second="b"):
    """Two long words that a polynomial of their bytes cannot tell apart modulo a power of two."""
    one, two = first, second
    while len(one) < n:
        one, two = one + two, two + one
    return one, two


def test_words_alike_are_told_apart(spark):
    words = [f"w{k}" for k in range(31)]
    a, b = _doubled(1024)
    texts = [(1, " ".join([*words[:10], a, *words[11:]])), (2, " ".join([*words[:10], b, *words[11:]]))]
    got = rows(join(spark.createDataFrame(texts, "doc_id long, text string")))
    assert got == sorted(brute_force(texts), key=str) and all(r[2] == 0 for r in got)


def test_chains_cut_by_buckets_lose_no_link(spark):
    """Components of more blocks than bands, a chain and a group of near copies among them."""
    rng = random.Random(4)
    words = [f"v{k}" for k in range(5000)]
    chain = [rng.choice(words) for _ in range(600)]
    texts = [(k, " ".join(chain[k * 3 : k * 3 + 100])) for k in range(160)]
    base = [rng.choice(words) for _ in range(80)]
    for k in range(200, 360):
        own = list(base)
        own[rng.randrange(80)] = rng.choice(words)
        texts.append((k, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(join(df, block_rows=2)) == rows(join(df)) == sorted(brute_force(texts), key=str)


def test_recall_by_band_of_similarity(spark):
    """Pairs from 0.8 on, each in a group of its own, by similarity."""
    rng = random.Random(6)
    words = [f"u{k}" for k in range(20000)]
    texts, k = [], 0
    for changed in (1, 2, 3, 4, 5):
        for _ in range(40):
            own = [rng.choice(words) for _ in range(220)]
            other = list(own)
            for p in range(changed):
                other[20 + 40 * p] = rng.choice(words)
            texts += [(k, " ".join(own)), (k + 1, " ".join(other))]
            k += 2
    want = sorted(brute_force(texts), key=str)
    assert {r[2] for r in want[:80]} <= {0, 1} and sum(r[2] for r in want) >= 300
    assert rows(join(spark.createDataFrame(texts, "doc_id long, text string"))) == want


def _dealt(spark, monkeypatch, texts, blocks):
    """How often texts are sent to a block, and the result, if components have so many blocks."""
    from pyspark.sql import functions as F

    from corpusloom.llm import jaccard_join as jj

    counts, met = [], jj.Join._met

    def counted(self, member):
        out = met(self, member)
        counts.append(out.agg(F.sum(F.size("others"))).first()[0])
        return out

    with monkeypatch.context() as m:
        m.setattr(jj.Join, "_met", counted)
        m.setattr(jj.Join, "_blocks", lambda self: F.lit(blocks))
        got = rows(join(spark.createDataFrame(texts, "doc_id long, text string")))
    return counts[0], got


def test_no_size_from_which_near_copies_are_sent_out_more(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"c{k}" for k in range(5000)]
    base = [rng.choice(words) for _ in range(300)]
    texts = []
    for k in range(200):
        own = list(base)
        own[rng.randrange(300)] = rng.choice(words)
        texts.append((k, " ".join(own)))
    want = sorted(brute_force(texts), key=str)
    few, got = _dealt(spark, monkeypatch, texts, 67)
    assert got == want and few <= 200 * 67
    more, got = _dealt(spark, monkeypatch, texts, 100)
    assert got == want and more <= 1.6 * few


def test_a_chain_is_sent_to_its_neighbours_alone(spark, monkeypatch):
    rng = random.Random(10)
    chain = [f"d{rng.randrange(9000)}" for _ in range(1400)]
    texts = [(k, " ".join(chain[k * 8 : k * 8 + 200])) for k in range(150)]
    want = sorted(brute_force(texts), key=str)
    assert max(r[3] for r in want) > 100
    for blocks in (20, 90):
        sent, got = _dealt(spark, monkeypatch, texts, blocks)
        assert got == want and sent < 150 * 25  # of 90 each
