import random

import xxhash

from corpusloom.llm import url_filter as uf


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best.key if best else None, "allow" if best is None or best.allow else "block"


ODD = [None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://A.Example.com/en/x", "http://www.example.com/en/", "http://xexample.com/en/", "http://a.net/es/?q", "http://net?/es/", "x://y://z.net/fr/", "http://é.com/é#", "http://a.com:80/", "\nhttp://b.net/es/\n", "http://" + "a." * 3000 + "com/" + "p" * 50000]


def test_rules(spark):
    df = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(ODD)], "page_id int, url string, rule string")
    for parts in (1 << 20, 30):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.apply_rules(df, uf.RULES, max_index_bytes=parts).collect()}
        assert got == {k: brute(u, uf.RULES) for k, u in enumerate(ODD)}
    assert uf.apply_rules(df.limit(0), uf.RULES).collect() == []
    assert {r.verdict for r in uf.apply_rules(df, []).collect()} == {"allow"}


def test_many_rules(spark):
    rng = random.Random(2)
    label = lambda: rng.choice("abc")
    rules = [uf.Rule(".".join(label() for _ in range(rng.randrange(1, 4))), "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(3))), rng.random() < 0.5) for _ in range(300)]
    rules = list({r.key + "|" + r.host: r for r in rules}.values())
    urls = [f"http://{'.'.join(label() for _ in range(rng.randrange(1, 5)))}/{''.join(rng.choice('xy/') for _ in range(4))}" for _ in range(500)]
    got = uf.apply_rules(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, url string"), rules).orderBy("k").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [brute(u, rules) for u in urls]


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    real = xxhash.xxh64_intdigest
    monkeypatch.setattr(uf.xxhash, "xxh64_intdigest", lambda k: real(k) % 3)
    path = tmp_path / "i"
    keys = [f"h{k}" for k in range(40)]
    path.write_bytes(uf.build_index([uf.Rule(k, "/", True) for k in keys]))
    index = uf.DigestIndex(str(path))
    found = index.find([uf._key(k, "/") for k in keys] + [b"none\0/"])
    assert [index.string(int(i)) for i in found[:-1]] == [uf._key(k, "/") for k in keys] and found[-1] == -1


def test_ties_do_not_depend_on_the_split(spark):
    from corpusloom.llm.url_filter import Rule, apply_rules

    rules = [Rule("a.b.com", "/", False), Rule("b.com", "/xy", True), Rule("b.com", "/xy", False), Rule("b.com", "/xy", True), Rule("com", "/", False)]
    df = spark.createDataFrame([(1, "http://a.b.com/xyz"), (2, "http://c.b.com/xyz"), (3, "http://d.com/"), (4, None)], "page_id long, url string")
    whole = sorted(map(tuple, apply_rules(df, rules).collect()))
    assert [r[3:] for r in whole] == [("a.b.com/", "block"), ("b.com/xy", "allow"), ("com/", "block"), (None, "allow")]
    for size in (1, 20, 60):
        assert sorted(map(tuple, apply_rules(df, rules, max_index_bytes=size).collect())) == whole
