import json
import random

import pytest

from corpusloom.llm import token_counts as tc


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tc.tokenizer_path())


PARTS = [
    " ", "  ", "\n", "\n\n ", "\t", "word", " word", "Zürich", "'s", "'", "'ll", "don't", "12345", " 9", "…", "!!!", " ", "日本語", "🙂", "🙂🙂‍👩", "é́", "<|endoftext|>",
    "<|endof", "text|>", "<|", "|>", "a" * 40, "-" * 30, " " * 25, "\r\n", "x y", " ",
]


def texts(n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(size))) for _ in range(n)]


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 8), (64, 1), (100, 40), (300, 64)])
def test_spliced_ids_are_those_of_the_whole(plain, chunk, overlap):
    spliced = tc.Spliced(tc.tokenizer_path(), chunk, overlap)
    for text in texts(150, 300, chunk):
        got = [i for piece in spliced.pieces(text) for i in piece.tolist()]
        assert got == plain.encode(text, add_special_tokens=False).ids


def test_overlaps_widen(plain):
    spliced = tc.Spliced(tc.tokenizer_path(), 64, 8)
    for text in ("a" * 5000, "ab" * 700 + " " + "c" * 900, " " * 3000 + "x", "日" * 800, "<|endoftext|>" * 90, "1" * 999 + "."):
        assert spliced.count(text) == len(plain.encode(text, add_special_tokens=False))
    assert spliced.widened > 5


def test_work_on_one_long_word_stays_bounded(plain, monkeypatch):
    spliced, seen = tc.Spliced(tc.tokenizer_path(), 64, 8), []
    one = spliced._encoded
    monkeypatch.setattr(spliced, "_encoded", lambda text, a, b: (seen.append(b - a), one(text, a, b))[1])
    text = "ab" * 20000
    assert spliced.count(text) == len(plain.encode(text, add_special_tokens=False))
    assert sum(seen) < 12 * len(text)


def test_special_string_over_a_chunk_end(plain):
    for shift in range(40):
        text = "x " * 30 + "y" * shift + "  <|endoftext|>  z" + " w" * 60
        spliced = tc.Spliced(tc.tokenizer_path(), 80, 16)
        assert [i for p in spliced.pieces(text) for i in p.tolist()] == plain.encode(text, add_special_tokens=False).ids


def test_rules_that_prove_nothing():
    rules = json.load(open(tc.tokenizer_path(), encoding="utf-8"))
    assert tc.splice_margin(rules) == len("<|endoftext|>") + 2
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": rules["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [rules["added_tokens"][0] | {"lstrip": True}]}):
        assert tc.splice_margin(rules | change) is None


def test_odd_rows(spark, plain):
    rows = [(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, "long text, " * 20000), (5, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, 7, "n") for r in rows], "doc_id long, text string, n_tokens int, n_bytes string")
    got = tc.count_tokens(df, chunk=4096, overlap=64)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens"]
    want = sorted((str(i), len(plain.encode(t or "", add_special_tokens=False))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == want
    assert tc.count_tokens(df.limit(0)).collect() == []


def test_whole_table(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), n := len(plain.encode(r.text or "", add_special_tokens=False)), n > 1024) for r in docs)
    got = tc.query(spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect())) == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
