import hashlib
import random
import re

from corpusloom.llm.decontaminate import Benchmark, WuManber, clean, query, scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_whole_table(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = sorted(map(tuple, query(spark, sf).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    assert any(r[5] for r in got)


def fixture():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(8)] + ["Été", "x1"]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(line(rng.choice([0, 1, 3, 9, 10, 14, 30])))) for k in range(12)] + [(3, "again"), (50, None), (None, "w0 w1"), (60, "same " * 12)]
    docs = [(k, (", " if k % 2 else " ").join(line(rng.randrange(120))).upper()) for k in range(40)]
    docs += [(100 + k, "a - " + t + " - b") for k, (_, t) in enumerate(items) if t]
    return [*docs, (None, "w0 w1"), (200, None), (201, ""), (202, "same " * 40), (203, "!? -"), (0, "dup"), (204, "z" * 300000)], items


def test_odd_rows(spark):
    docs, items = fixture()
    df = spark.createDataFrame([(*r, "h", 7) for r in docs], "doc_id long, text string, hits string, n_words int")
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    want = brute(docs, [r for r in items if r[0] is not None])
    for size in (8 << 20, 40):  # in one pass, and in several
        rows = scan(df, bench, table_bytes=size).collect()
        got = [(r.doc_id, r.n_words, sum(b - a for a, b in r.hits), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.hits)) for r in rows]
        assert sorted(got, key=str) == want
    kept = clean(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[5]), key=str)
    assert scan(df.limit(0), bench).collect() == [] and scan(df, bench.limit(0)).where("size(items) > 0").count() == 0


def test_shifts():
    table = WuManber({(b"a", b"b", b"c", b"d"): frozenset("1"), (b"x", b"a", b"b", b"c"): frozenset("2")})
    assert table.default == 3 and table.shift[(b"b", b"c")] == 0 and table.shift[(b"a", b"b")] == 1
    assert [k for k, _ in table.find(b"z x a b c d a b c d".split())] == [1, 2, 6]
    assert Benchmark([("1", b"a b")], 2).hits([b"a", b"b", b"a", b"b"]) == ([(0, 4)], {"1"})
