import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import collocations as co


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, depth=4, least=30, top=2000):
    """The contract, word by word."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, depth + 1):
                for k in range(len(w) - m + 1):
                    f[lang][tuple(w[k : k + m])] += 1
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in some.items():
            around = [b for q, b in some.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in around):
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def collected(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def fixture():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(9)] + ["Été", "ÉTÉ", "x y", "ab'c"]
    rows = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if k % 3 == 0:
            words += ["New", "York  City", "Hall"] * 2
        joined = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\r\n"]) for w in words)
        rows.append((joined, rng.choice(["en", "en", "en", "fr", None])))
    return [*rows, (None, "en"), ("", "en"), (" .\n,", "de"), ("one", "de"), ("same same " * 500, "en"), (("long tail " * 3000), "fr"), ("same same " * 500, "en")]


@pytest.mark.parametrize(("least", "shard"), [(30, 8 << 20), (3, 8 << 20), (3, 500), (1, 100)])
def test_equals_brute_force(spark, least, shard):
    rows = fixture()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, f int").repartition(3)
    assert collected(co.collocations(df, least=least, shard_bytes=shard)) == brute(rows, least=least)


def test_few_best_and_empty(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "text string, lang string")
    assert collected(co.collocations(df, least=2, top=5)) == brute(rows, least=2, top=5)
    assert co.collocations(df.limit(0)).collect() == []
    assert collected(co.collocations(df, depth=2, least=2)) == brute(rows, depth=2, least=2)


def test_full_filters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "FILTER_WORDS", 1)
    rows = fixture()
    assert collected(co.collocations(spark.createDataFrame(rows, "text string, lang string"), least=3)) == brute(rows, least=3)


def test_large_counts(spark):
    class Given:
        frequent = spark.createDataFrame(
            [("en", "a", 1, 9_000_000_000_000_000), ("en", "b", 1, 9_000_000_000_000_001), ("en", "a b", 2, 8_999_999_999_999_999)], "lang string, phrase string, m long, f long"
        )

    (row,) = co.scored(Given).collect()
    assert row.score == 2000000 * row.a // (row.l + row.r)


def classes(words, pieces, depth):
    """End positions of every phrase, by definition."""
    ends = defaultdict(set)
    for i in range(len(words)):
        for m in range(1, depth + 1):
            if i - m + 1 >= 0 and pieces[i - m + 1] == pieces[i]:
                ends[tuple(words[i - m + 1 : i + 1])].add(i)
    return ends


def test_states_links_and_counts():
    rng = random.Random(3)
    for _ in range(60):
        size = rng.randrange(1, 60)
        words = [rng.randrange(4) for _ in range(size)]
        pieces = np.cumsum([rng.random() < 0.15 for _ in range(size)])
        room = [1]
        for i in range(1, size):
            room.append(min(4, room[-1] + 1) if pieces[i] == pieces[i - 1] else 1)
        made = co.Automaton(np.array(words), np.array(room), 4)
        ends = classes(words, pieces, 4)
        groups = defaultdict(list)
        for p, e in ends.items():
            groups[frozenset(e)].append(p)
        states = {}
        for m, where, shortest, count in made.states():
            for w, s, c in zip(where.tolist(), shortest.tolist(), count.tolist(), strict=True):
                states[tuple(words[w - m + 1 : w + 1])] = (s, c)
        # A state for each class, named by its longest phrase, which has all shorter ones as suffixes.
        assert states == {max(g, key=len): (min(map(len, g)), len(e)) for e, g in groups.items()}
        for m in range(2, 5):
            for w, link in zip(made.where[m].tolist(), made.link[m].tolist(), strict=True):
                suffix = made.where[m - 1][link]
                assert words[suffix - m + 2 : suffix + 1] == words[w - m + 2 : w + 1]


def test_shards_cut_between_pieces():
    import pyarrow as pa

    text = "a b. " * 100 + "long piece " * 50
    batch = pa.RecordBatch.from_arrays([pa.array(["en", None, "en"]), pa.array([text, "x y", None])], names=["lang", "text"])
    got = list(co.shards([batch], 64))
    assert max(len(t) for lang, t in got if lang == "en") < 700
    assert sum(t.count(b"a b") for _, t in got) == 100 and [t for lang, t in got if lang == "und"] == [b"x y"]


def test_whole_table_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert collected(co.query(spark, sf)) == sorted(con.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({co.SQL})").fetchall())
