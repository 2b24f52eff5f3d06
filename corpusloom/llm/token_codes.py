"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first; level 0 holds the first chunk
of every id, level k+1 the next chunk of those ids that continue after level k.
Each level has a bitmap telling which ids continue and a directory of the set
bits before every 512th, so any token is found by one rank per level, without
decoding a block. A file is a run of segments in ascending document order, each
with an index of its documents, and a directory of the segments at its end, so
a token is read from a file (``TokenFile``) by a few reads of some bytes.

Defined results: a null or empty text is its end id alone; a null document id
comes first and is kept; rows with equal ids are ordered by a hash of the text,
and equal rows are written each; an empty table gives no file and no row; a very
long text is one segment's at least, held whole by one task. Extra columns, of
whatever names, are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._shared import attempt_name, binary, blocks, filesystem, saved, shared_dir, small_batches, steps, write_file

END_ID = 2
#: Tokens after which a segment is closed (at the end of a document).
SEGMENT_TOKENS = 1 << 20
#: Slots of a worker process's memo of words, and ids kept in a slot: 2^20 slots are 36 MB.
MEMO_SLOTS, MEMO_IDS = 1 << 20, 8
#: Text bytes of one range of keys, where the session's shuffle partitions would have more; and the least.
RANGE_BYTES, LEAST_RANGE_BYTES = 128 << 20, 4 << 20
_BLOCK = 512
_MAGIC, _TAIL = b"DACTOK02", b"DACDIR02"
_SEGMENT = struct.Struct("<QQQB7x")
_LEVEL = struct.Struct("<Q")
#: Of each segment: where it begins in the file, and the first of its tokens; at the very end, how many there are.
_ENTRY, _END = struct.Struct("<QQ"), struct.Struct("<Q8s")


class Codes:
    """An array of unsigned ids as directly addressable codes."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        levels, rest = [], ids.astype(np.uint32)
        while True:
            more = rest > 255
            ones = np.concatenate([np.add.reduceat(more, np.arange(0, len(more), _BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)])
            levels.append(((rest & 255).astype(np.uint8), np.packbits(more, bitorder="little"), (np.cumsum(ones, dtype=np.uint32) - ones).astype(np.uint32)))
            if not more.any():
                return cls(levels)
            rest = rest[more] >> np.uint32(8)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, at: int) -> int:
        """One id, by a rank at each level."""
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[at]) << 8 * k
            if not bits[at >> 3] >> (at & 7) & 1:
                return value
            first = at // _BLOCK * _BLOCK
            before = int.from_bytes(bits[first >> 3 : (at >> 3) + 1].tobytes(), "little") & ((1 << at - first) - 1)
            at = int(ranks[at // _BLOCK]) + before.bit_count()
        raise ValueError("an id continues after the last level")

    def all(self) -> np.ndarray:
        """All ids at once."""
        value = np.zeros(0, dtype=np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            more = np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)
            whole = chunk.astype(np.uint32)
            whole[more] |= value << np.uint32(8)
            value = whole
        return value

    def to_bytes(self) -> bytes:
        return b"".join(x for chunk, bits, ranks in self.levels for x in (_LEVEL.pack(len(chunk)), chunk.tobytes(), bits.tobytes(), ranks.tobytes()))

    @classmethod
    def from_bytes(cls, raw: bytes, count: int) -> Codes:
        levels, at = [], 0
        for _ in range(count):
            (n,) = _LEVEL.unpack_from(raw, at)
            at += _LEVEL.size
            parts = []
            for kind, size in ((np.uint8, n), (np.uint8, -(-n // 8)), (np.uint32, -(-n // _BLOCK))):
                parts.append(np.frombuffer(raw, dtype=kind, count=size, offset=at))
                at += parts[-1].nbytes
            levels.append(tuple(parts))
        if at != len(raw):
            raise ValueError("a segment's levels do not fill it")
        return cls(levels)


def segment(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """Documents and their ids; a null document id is marked by a bit of its own."""
    codes = Codes.of(ids)
    body = codes.to_bytes()
    known = np.packbits(np.array([d is not None for d in doc_ids], dtype=bool), bitorder="little").tobytes()
    index = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + np.array(sizes, dtype="<u8").tobytes() + known
    return _SEGMENT.pack(len(doc_ids), len(ids), len(body), len(codes.levels)) + index + body


def read_segments(uri: str) -> Iterator[tuple[list[int | None], np.ndarray, Codes]]:
    """(document ids, their numbers of tokens, codes) of each segment of a file."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as file:
        where, _ = _segments(file, uri)
        for at in where:
            file.seek(at)
            n, tokens, size, levels = _SEGMENT.unpack(file.read(_SEGMENT.size))
            raw = file.read(16 * n + -(-n // 8))
            ids, sizes = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u8", n, 8 * n).astype(np.int64)
            known = np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 * n), count=n, bitorder="little")
            body = file.read(size)
            codes = Codes.from_bytes(body, levels)
            if len(body) != size or len(codes) != tokens or sizes.sum() != tokens:
                raise ValueError(f"{uri}: a segment's lengths disagree")
            yield [int(i) if k else None for i, k in zip(ids, known, strict=True)], sizes, codes


def _segments(file, uri: str) -> tuple[list[int], list[int]]:
    """Where a file's segments begin, and the number of the first token of each, from the directory at its end."""
    size = file.size()
    if size < len(_MAGIC) + _END.size or file.read_at(len(_MAGIC), 0) != _MAGIC:
        raise ValueError(f"{uri} is no token file")
    n, tail = _END.unpack(file.read_at(_END.size, size - _END.size))
    begin = size - _END.size - n * _ENTRY.size
    if tail != _TAIL or begin < len(_MAGIC):
        raise ValueError(f"{uri}: the directory of segments is broken")
    entries = list(_ENTRY.iter_unpack(file.read_at(n * _ENTRY.size, begin)))
    return [e[0] for e in entries], [e[1] for e in entries]


def directory(entries: list[tuple[int, int]]) -> bytes:
    """The end of a file: where its segments begin and their first tokens."""
    return b"".join(_ENTRY.pack(*e) for e in entries) + _END.pack(len(entries), _TAIL)


class TokenFile:
    """Any token of a file by its number: for each level its length, a chunk, a part of the bitmap and a rank are read, nothing else."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        self.where, self.first = _segments(self.file, uri)

    def __getitem__(self, at: int) -> int:
        k = bisect_right(self.first, at) - 1
        if at < 0 or k < 0:
            raise IndexError(at)
        n, tokens, _, levels = _SEGMENT.unpack(self.file.read_at(_SEGMENT.size, self.where[k]))
        at, value = at - self.first[k], 0
        if at >= tokens:
            raise IndexError(at)
        spot = self.where[k] + _SEGMENT.size + 16 * n + -(-n // 8)
        for level in range(levels):
            (size,) = _LEVEL.unpack(self.file.read_at(_LEVEL.size, spot))
            chunks = spot + _LEVEL.size
            bits, block = chunks + size, at // _BLOCK
            ranks = bits + -(-size // 8)
            value |= self.file.read_at(1, chunks + at)[0] << 8 * level
            here = int.from_bytes(self.file.read_at(at // 8 - block * _BLOCK // 8 + 1, bits + block * _BLOCK // 8), "little")
            if not here >> at - block * _BLOCK & 1:
                return value
            rank = int.from_bytes(self.file.read_at(4, ranks + 4 * block), "little")
            at, spot = rank + (here & (1 << at - block * _BLOCK) - 1).bit_count(), ranks + 4 * -(-size // _BLOCK)
        raise ValueError("an id continues after the last level")

    def close(self) -> None:
        self.file.close()


_encoders: dict[str, Encoder] = {}
_CUT = bytes(0x20 if b == 0x0A else b for b in range(256))
_SPACE, _POINT, _ALNUM = (np.isin(np.arange(256), list(x)) for x in (b" \n", b".,", b"abcdefghijklmnopqrstuvwxyz0123456789"))
#: The rules of a tokenizer that drops white space and lower-cases (fixed values): its ids are those of its words in a row.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Of a word's bytes packed in an integer, those that belong to it.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def by_words(tokenizer) -> bool:
    """Whether a tokenizer's rules are those of :class:`Encoder`'s shortcut."""
    rules = json.loads(tokenizer.to_str())
    normal, before = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}
    splits = before.get("pretokenizers", [])
    return (
        normal.get("normalizers") == _NORMAL
        and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        and (splits[0]["pattern"], splits[0]["behavior"], splits[0]["invert"]) == ({"Regex": _SPLIT}, "Removed", True)
        and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        and rules["post_processor"] is None and not rules["model"]["dropout"]
    )


class Memo:
    """Ids of short words in a direct-mapped table of fixed size: a word's own bytes are the key, so a hit is exact."""

    def __init__(self, slots: int, kind: type):
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.size, self.count = np.zeros(slots, np.uint8), np.zeros(slots, np.uint8)
        self.ids = np.zeros((slots, MEMO_IDS), kind)

    def keys(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' bytes as two integers, and their slots; ``data`` has 16 bytes more than its words."""
        packed = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        low = packed[starts] & _MASK[np.minimum(size, 8)]
        high = packed[starts + 8] & _MASK[np.clip(size - 8, 0, 8)]
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7))) * np.uint64(0xD6E8FEB86659FD93)
        return low, high, ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) >> self.shift).astype(np.int64)

    def has(self, low, high, slot, size) -> np.ndarray:
        return (self.low[slot] == low) & (self.high[slot] == high) & (self.size[slot] == size)

    def put(self, low, high, slot, size, first: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
        """Keep these words; of words of one slot, and of a slot's old word and a new one, the last stays."""
        place = np.unique(slot[::-1], return_index=True)[1]  # one word for each slot, so that its fields agree
        place = len(slot) - 1 - place
        low, high, slot, size, first, count = (x[place] for x in (low, high, slot, size, first, count))
        self.low[slot], self.high[slot], self.size[slot], self.count[slot] = low, high, size, count
        for k in range(MEMO_IDS):
            more = count > k
            self.ids[slot[more], k] = flat[first[more] + k]


class Encoder:
    """A tokenizer, with a memo of the ids of words where its rules allow that.

    A tokenizer that drops white space never joins what a space or a line feed
    separates, nor a letter or digit and the point or comma after it, so a
    text's ids are those of these pieces in a row. It lower-cases, too, so
    pieces are remembered in lower case; unless the texts hold combining marks,
    which may compose with a small letter alone, or what may be a special
    token. Any other tokenizer is given whole texts.
    """

    def __init__(self, path: str, slots: int = MEMO_SLOTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = by_words(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.memo = Memo(slots, np.uint16 if max(vocabulary.values(), default=0) < 1 << 16 else np.uint32)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        (self.mark,) = self._ids([b"|"])

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this worker process, with what it remembers from earlier tasks."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(one.ids, dtype=np.uint32) for one in found]

    def _joined(self, words: list[bytes], gap: bytes, last: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(number of ids of each word, all of them in a row) of words encoded in one go; ``last`` marks the ids that end one, or is the mark's between two."""
        (ids,) = self._ids([gap.join(words)])
        if gap == b" ":
            ends = np.flatnonzero(last[ids]) + 1
            counts = np.diff(ends, prepend=0)
            fits = len(ends) == len(words) and ends[-1] == len(ids)
        else:
            marks = np.flatnonzero(ids == last[0])
            counts = np.diff(marks, prepend=-1, append=len(ids)) - 1
            fits = len(counts) == len(words)
            ids = np.delete(ids, marks)
        return (counts, ids) if fits else None

    def _learned(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids in a row) of distinct words.

        ASCII letters alone are one unit each, whose last id ends a word. Of the
        other words, those without the mark are told apart by it.
        """
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for k, w in enumerate(words):
            kinds[0 if w.isalpha() else 1 if b"|" not in w else 2].append(k)
        plain, marked, rest = kinds
        found = [(plain, self._joined([words[k] for k in plain], b" ", self.ends)) if plain else None, (marked, self._joined([words[k] for k in marked], b" | ", self.mark)) if marked and len(self.mark) == 1 else (marked, None)]
        done = []
        for one in found:
            if one and one[1] is not None:
                done.append((one[0], *one[1]))
            elif one:
                rest = rest + one[0]
        own = self._ids([words[k] for k in rest])
        done.append((rest, np.array([len(x) for x in own], dtype=np.int64), np.concatenate([np.empty(0, np.uint32), *own])))
        counts = np.zeros(len(words), dtype=np.int64)
        for at, n, _ in done:
            counts[at] = n
        flat, first = np.empty(counts.sum(), dtype=np.uint32), np.cumsum(counts) - counts
        for at, n, ids in done:
            flat[_runs(first[at], n)] = ids
        return counts, flat

    def __call__(self, texts: list[bytes], end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids in a row), each text with ``end`` after it."""
        if not self.by_words:
            own = self._ids(texts)
            sizes = np.array([len(x) for x in own], dtype=np.int64)
            return sizes + 1, np.insert(np.concatenate([np.empty(0, np.uint32), *own]), np.cumsum(sizes), end).astype(np.uint32)
        whole = b"\n".join([b"", *texts, b""])
        text_at = np.cumsum([1, *[len(t) + 1 for t in texts]])
        data = np.frombuffer(whole, dtype=np.uint8)
        if b"<|" not in whole and b"\xcc" not in whole and b"\xcd" not in whole:
            data = np.frombuffer(whole.lower(), dtype=np.uint8)
            cut = np.flatnonzero(_ALNUM[data[:-2]] & _POINT[data[1:-1]] & _SPACE[data[2:]]) + 1 if len(data) > 2 else np.empty(0, dtype=np.int64)
            data = np.insert(data, cut, 0x20)
            text_at = text_at + np.searchsorted(cut, text_at)
        edges = np.flatnonzero(np.diff(_SPACE[data])) + 1
        starts, ends = edges[::2], edges[1::2]
        size = ends - starts
        data = np.concatenate([data, np.zeros(16, np.uint8)])
        low, high, slot = self.memo.keys(data, starts, size)
        short = size <= 16
        hit = short & self.memo.has(low, high, slot, size)
        counts, first = np.where(hit, self.memo.count[slot], 0).astype(np.int64), slot * MEMO_IDS
        lost = np.flatnonzero(~hit)
        raw = data.tobytes()
        places: dict[bytes, int] = {}
        code = np.fromiter((places.setdefault(raw[a:b], len(places)) for a, b in zip(starts[lost].tolist(), ends[lost].tolist(), strict=True)), dtype=np.int64, count=len(lost))
        learned, flat = self._learned(list(places))
        begin = np.cumsum(learned) - learned
        counts[lost], first[lost] = learned[code], begin[code]
        before = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), dtype=np.uint32)
        out[_runs(before[hit], counts[hit])] = self.memo.ids.ravel()[_runs(first[hit], counts[hit])]
        out[_runs(before[lost], counts[lost])] = flat[_runs(first[lost], counts[lost])]
        new = lost[short[lost] & (counts[lost] <= MEMO_IDS)]
        if len(new):
            self.memo.put(low[new], high[new], slot[new], size[new], first[new], counts[new], flat)
        total = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, text_at)]
        sizes = np.diff(total)
        return sizes + 1, np.insert(out, np.cumsum(sizes), end).astype(np.uint32)


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., ``count[0]`` of them, then the same of first[1], ..."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def write_tokens(df: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Encode ``df`` into files below ``folder``, in ascending ``key`` order; the saved table of them.

    One shuffle, by ranges of the key (and a hash of the text, should one key
    hold many rows). A lost task writes its file anew under another name; only
    what the committed table names is read.
    """
    spark = df.sparkSession
    small_batches(spark)
    order = [F.col(key).asc_nulls_first(), F.xxhash64(text).asc()]
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = max(blocks(size, RANGE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks(size, LEAST_RANGE_BYTES)))
    rows = df.select(key, text).repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(F.col(key).cast("long"), text)

    def run(batches):
        encode = Encoder.of(tokenizer)
        part = TaskContext.get().partitionId()
        uri, totals = f"{folder}/{attempt_name(part)}.dac", [0, 0]

        def content():
            yield _MAGIC
            docs, sizes, ids, held, entries, at = [], [], [], 0, [], len(_MAGIC)

            def closed():
                nonlocal at
                entries.append((at, totals[1] - held))
                raw = segment(docs, sizes, np.concatenate(ids))
                at += len(raw)
                return raw

            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), [t or b"" for t in binary(batch.column(1))]
                for a, b in steps(texts):
                    n, out = encode(texts[a:b], end)
                    docs += keys[a:b]
                    sizes += n.tolist()
                    ids.append(out)
                    held += len(out)
                    totals[0] += b - a
                    totals[1] += len(out)
                    if held >= segment_tokens:
                        yield closed()
                        docs, sizes, ids, held = [], [], [], 0
            if docs:
                yield closed()
            yield directory(entries)

        size = write_file(uri, content())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([uri]), *[pa.array([x], pa.int64()) for x in (*totals, size)]], names=["file_no", "path", "n_docs", "n_tokens", "n_bytes"])

    files = saved(rows.mapInArrow(run, "file_no long, path string, n_docs long, n_tokens long, n_bytes long").where("n_docs > 0"), "token-files")
    # One row for each file: the offsets of whole files are few.
    return files.withColumn("start", F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["start"])


def read_tokens(files: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids, if asked for) of each document, read from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for uri, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for docs, sizes, codes in read_segments(uri):
                    whole = codes.all().astype("<u4")
                    ends = np.cumsum(sizes)
                    starts = ends - sizes
                    sums = [zlib.crc32(whole[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                    columns = [pa.array(docs, pa.int64()), pa.array(starts + at), pa.array(sizes), pa.array(sums, pa.int64())]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(whole)), pa.int32()), pa.array(whole.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    at += int(len(codes))

    n = max(1, files.count())
    return files.select("path", "start").repartition(n).mapInArrow(run, schema)


def tokens_of(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to shared storage and read the files back."""
    return read_tokens(write_tokens(docs, tokenizer, shared_dir(docs.sparkSession, "tokens")))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
