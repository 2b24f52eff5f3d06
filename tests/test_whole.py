"""The registered queries do the whole job: whole texts, every row, every step."""

import re
import zlib
from itertools import combinations

import numpy as np

from corpusloom.operators import chunk as ch
from corpusloom.operators import keywords as kw
from corpusloom.plans import corpus_queries  # noqa: F401  registers the queries
from corpusloom.plans.registry import QUERIES
from corpusloom.streaming import ingest


def dense_vector(phrase):
    out = np.zeros(512)
    for word in phrase.split():
        padded = f"<{word}>"
        for n in (3, 4):
            for k in range(len(padded) - n + 1):
                h = zlib.crc32(padded[k : k + n].encode())
                out[h % 512] += 1 if h >> 16 & 1 else -1
    return out / (np.linalg.norm(out) or 1)


def ranked(text, most):
    """The definition, with a dense vector for each candidate."""
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if len(w) > 1 and w not in kw.STOP_WORDS]
    phrases = sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})
    vectors = {p: dense_vector(p) for p in phrases}
    near = {p: float(vectors[p] @ dense_vector(" ".join(words))) for p in phrases}
    return sorted(phrases, key=lambda p: (-round(near[p], 9), p))[:most], vectors, near


def brute_max_sum(text):
    phrases, vectors, _ = ranked(text, kw.CANDIDATES)
    sets = list(combinations(phrases, kw.TOP))
    return list(min(sets, key=lambda s: round(sum(float(vectors[a] @ vectors[b]) for a, b in combinations(s, 2)), 9))) if sets else phrases


def brute_marginal(text):
    phrases, vectors, near = ranked(text, 1 << 30)
    taken = []
    while len(taken) < min(kw.TOP, len(phrases)):
        rest = [p for p in phrases if p not in taken]
        worth = lambda p: round((1 - kw.DIVERSITY) * near[p] - kw.DIVERSITY * max([float(vectors[p] @ vectors[t]) for t in taken], default=0.0), 9)
        taken.append(max(rest, key=worth))
    return taken


def test_keyword_queries_read_every_document(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    some = sorted(docs, key=lambda i: (len(docs[i]), i))[:: max(1, len(docs) // 12)]
    for name, brute in (("keywords_maxsum", brute_max_sum), ("keywords_mmr", brute_marginal)):
        got = {r.doc_id: r.keywords for r in QUERIES[name](spark, sf).collect()}
        assert got.keys() == docs.keys()
        assert all(got[i] == (brute(docs[i]) if len(docs[i].strip()) >= kw.LEAST_CHARS else []) for i in some)


def brute_sentence_chunks(text, size):
    out, now = [], []
    for s in [x for x in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)) if x]:
        if now and sum(map(len, now)) + len(s) > size:
            out.append(" ".join(now))
            now = []
        now.append(s)
    out += [" ".join(now)] if now else []
    k, merged = 0, []
    while k < len(out):
        item = lambda j: j < len(out) and re.match(ch.LIST_ITEM, out[j])
        two = item(k) and len(out[k]) < size * 0.5 and item(k + 1)
        merged.append(out[k] + "\n" + out[k + 1] if two else out[k])
        k += 2 if two else 1
    return merged


def test_short_list_chunks_are_merged(spark, sf):
    long = "- " + "x" * 30
    texts = ["", "Plain.", f"- a.\n{long}.\n- b.\n{long}!\n- c.", f"- a.\n{long}. Plain {'y' * 30}.\n- b.", f"{long}.\n{long}.\n* d.", f"- a.\n{long}.\n{long}.\n{long}."]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")
    got = ch.chunk_documents(df, strategy="sentences", size=32).orderBy("path", "chunk_index").collect()
    want = [(str(k), c) for k, t in enumerate(texts) for c in brute_sentence_chunks(t, 32)]
    assert [(r.path, r.page_content) for r in got] == want and any("\n" in c for _, c in want)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sorted((r.doc_id, r.chunk_index, r.content) for r in QUERIES["chunk_sentences"](spark, sf).collect())
    assert rows == [(i, k, c) for i in sorted(docs) for k, c in enumerate(brute_sentence_chunks(docs[i], ch.SIZE))]


def test_chunks_have_keywords_and_frontmatter(spark, sf, tmp_path):
    block = 'title: "T: x"\n## note: no\nkeywords: old\nheader_2: Over\ntags:\n  - a\n  - b\ntitle: \'U: y\'\nurl: http://a/b'
    text = f"---\n{block}\n---\n# A\nsolar panel output and wind turbine cost\n## B\nshort"
    df = spark.createDataFrame([("p.md", text), ("q.md", "no frontmatter, solar panels alone")], "path string, text string")
    front = {"title": "U: y", "tags": "- a\n  - b", "url": "http://a/b", "header_2": "Over"}
    for strategy in ch.Strategy:
        rows = ch.chunk_documents(df, strategy=strategy).orderBy("path", "chunk_index").collect()
        assert all(r.keywords == (kw.max_sum(r.page_content) if len(r.page_content) >= kw.LEAST_CHARS else []) for r in rows) and rows[0].keywords
        heads = {"header_1": "A"} if strategy is ch.Strategy.HEADERS else {}
        assert [dict(r.metadata) for r in rows] == [{**heads, **front}] * (len(rows) - 1) + [{}]
        assert rows[0].section_path == ("A > Over" if heads else "Over") and rows[0].frontmatter == block
    plain = ch.chunk_documents(df, keywords=False)
    assert "keywords" not in plain.columns and dict(plain.where("path = 'p.md'").first().metadata)["keywords"] == "old"
    for name in ("chunk_pipeline", "chunk_pipeline_size"):
        rows = QUERIES[name](spark, sf).limit(20).collect()
        assert rows and all(r.keywords == (kw.max_sum(r.page_content) if len(r.page_content) >= kw.LEAST_CHARS else []) and dict(r.metadata)["license"] == "CC BY 4.0" for r in rows)


def test_collections_have_keywords_and_frontmatter(spark, tmp_path):
    root = str(tmp_path / "out")
    for batch, title in enumerate(("one", "two")):  # the second batch changes the frontmatter alone
        text = f"---\ntitle: {title}\n---\n# A\nsolar panel output and wind turbine cost"
        files = spark.createDataFrame([("a.md", len(text), text, "site", "site/a.md")], "name string, size long, content string, source string, path string")
        ingest.embed_batch(files, batch, root, "headers")
        (row,) = ingest.collection(spark, root).collect()
        assert row.keywords == kw.max_sum(row.page_content) and dict(row.metadata)["title"] == title
