import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm.token_codes import Codes, Encoder, TokenFile, query, read_tokens, tokenizer_path, write_tokens

ODD = ["", "  a á ΣΑΣ b c\td <|endoftext|>x it's IT'S\n\n12 3½ é", "İİ \x1fq\x85r", "\n", "don't 's.", "H̱ end. of, 3.14, ok.", "<|ENDOFTEXT|> THE. The, the", "日本語、テスト。", "ﬁ ① ％", "q " * 5000, "z" * 20000]


def expected(rows):
    t = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, query(spark, sf).collect())) == expected([tuple(r) for r in docs])


def test_encoder_equals_the_tokenizer():
    t, encode = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path(), slots=4)
    for texts in (ODD, ODD[:1], ODD[4:7], ["plain words, here. And there."] * 3):
        sizes, ids = encode([x.encode() for x in texts])
        at = 0
        for n, text in zip(sizes, texts, strict=True):
            assert ids[at : at + n].tolist() == [*t.encode(text, add_special_tokens=False).ids, 2], text
            at += n


def test_tokenizers_that_do_not_split_by_words_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, encode = Tokenizer.from_file(path), Encoder(path, slots=4)
    assert not encode.by_words and Encoder(tokenizer_path(), slots=4).by_words
    sizes, ids = encode([x.encode() for x in ODD])
    assert ids.tolist() == [i for x in ODD for i in [*t.encode(x, add_special_tokens=False).ids, 2]] and len(sizes) == len(ODD)


def test_random_texts_give_the_tokenizers_ids():
    t, encode, rng = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path(), slots=64), np.random.default_rng(5)
    parts = ["a", "bc", "The", "'s", ".", ",", " ", "  ", "\n", "\t", "-", "|", "<", "é", "\u0301", "ß", "\u00a0", "中", "3", "\0", "internationalisation"]
    for _ in range(300):
        texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(4)]
        assert encode([x.encode() for x in texts])[1].tolist() == [i for x in texts for i in [*t.encode(x, add_special_tokens=False).ids, 2]]


def test_odd_rows_and_small_segments(spark, tmp_path):
    rows = [(k, x) for k, x in enumerate(ODD)] + [(50, None), (None, "first")]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, start int")
    files = write_tokens(df, tokenizer_path(), str(tmp_path), segment_tokens=50)
    got = sorted(map(tuple, read_tokens(files).collect()), key=lambda r: r[1])
    assert got == expected(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    ids = {r.doc_id: r.ids for r in read_tokens(files, ids=True).collect()}
    assert all(len(ids[r[0]]) == r[2] for r in got)
    long = spark.createDataFrame([(k, f"w{k} " * 200_000) for k in range(3)], "doc_id long, text string").coalesce(1)
    files = write_tokens(long, tokenizer_path(), str(tmp_path), segment_tokens=50)
    whole = [x for r in read_tokens(files, ids=True).orderBy("start").collect() for x in r.ids]
    one = TokenFile(files.first().path)
    assert files.count() == 1 and len(one.where) == 3
    places = [0, 1, 511, 512, *range(7, len(whole), 9973), len(whole) - 1]
    assert [one[k] for k in places] == [whole[k] for k in places]
    for beyond in (-1, len(whole)):
        with pytest.raises(IndexError):
            one[beyond]
    one.close()
    twice = write_tokens(spark.createDataFrame([(1, "a"), (1, "b"), (1, "a")], "doc_id long, text string"), tokenizer_path(), str(tmp_path))
    assert sorted(r.start for r in read_tokens(twice).collect()) == [0, 2, 4]
    assert read_tokens(write_tokens(df.limit(0), tokenizer_path(), str(tmp_path))).collect() == []


def test_random_access():
    rng = np.random.default_rng(3)
    for high in (200, 50000, 1 << 32):
        ids = rng.integers(0, high, 3000, dtype=np.uint64).astype(np.uint32)
        codes = Codes.of(ids)
        again = Codes.from_bytes(codes.to_bytes(), len(codes.levels))
        assert (again.all() == ids).all() and [again[k] for k in range(len(ids))] == ids.tolist()
    assert len(Codes.of(np.zeros(0, np.uint32)).all()) == 0
