"""N-gram Jaccard join: LSH candidates, Bayesian pruning, exact verification.

Words are those of ``_words.MARKS`` in lower case; a shingle is ``SHINGLE``
consecutive words (or all words of a shorter text). Two documents are linked
when the Jaccard similarity of their sets of shingles is ``THRESHOLD`` or more.

1. Documents with equal sets (by their number and two independent 64-bit sums
   of hashes) are one class; a representative goes on.
2. Representatives that agree in all minima of some band are candidates. With
   68 bands of 6 minima a pair at the threshold is missed once in 1e9. Buckets
   with the same members (by their number and two 64-bit exclusive-ors of hashes) would
   give the same forest, so one of them is looked at. Signatures are computed
   where the texts lie, for representatives alone.
3. Within a band's bucket the minima's low bytes are compared 16 at a time, and
   a pair is dropped once the posterior probability that its similarity reaches
   the threshold (uniform prior) is below ``TOLERANCE``. What is left of a
   bucket is given by a spanning forest, never by its pairs.
4. Forests of all buckets make components; every link lies within one. In
   blocks of bounded size, the pairs of a component are compared by their
   minima in the same way, and those that survive are verified exactly: by the
   intersection of their shingles, told apart by their words, not by hashes.
   Of a component of several blocks, a row goes to those where another one shares
   a bucket with it, which narrow rows tell, so k near copies cost what their
   pairs do and a chain what its neighbours do. Two rows meet in one task only,
   so no pair counts twice. Only counts of links and again a forest leave a task.

Defined results: a text without words has no link and is a class of its own; of
rows with equal ids each is a document; null ids are allowed; a class is named
by its least id (null if all its ids are null), and of ties by their least place
in the input. An empty table gives an empty result; a very long text is one
row's set of shingles, held whole by one task at a time. Extra columns are not
read, whatever their names, or pass through :func:`keep_one`.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._components import components
from corpusloom.llm._parts import PART_BITS, PART_BYTES, PART_ROWS, each_part, read_part, write_parts
from corpusloom.llm._shared import binary, saved, steps
from corpusloom.llm._words import MARKS, NORMAL, exact_codes, exact_runs, mix, spans, window_hashes, word_lanes

SHINGLE, THRESHOLD = 5, "0.8"
BANDS, ROWS = 68, 6
#: Minima compared one after another, and how many at a time.
COMPARED, STEP = 128, 16
TOLERANCE = 1e-7
#: Representatives, and bytes of shingles, that one task compares with each other.
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20
_SEED = 0x9E3779B97F4A7C15
_RNG = np.random.Generator(np.random.PCG64(8))
_MULTIPLY = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of each text, and of each of them a second hash."""
    data, starts, ends, first = spans([t.translate(NORMAL) for t in texts], MARKS)
    lanes = word_lanes(data, starts, ends)
    whole = [window_hashes(lane, shingle, _SEED) for lane in lanes]
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= shingle:
            one, at = np.unique(whole[0][a : b - shingle + 1], return_index=True)
            out.append((one, whole[1][a + at]))
        elif b > a:
            out.append(tuple(window_hashes(lane[a:b], int(b - a), _SEED + int(b - a)) for lane in lanes))
        else:
            out.append((np.empty(0, np.uint64), np.empty(0, np.uint64)))
    return out


def exact_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text (of normal words) as numbers that are equal for equal words alone."""
    data, starts, ends, first = spans(texts, MARKS)
    words = exact_codes(data, starts, ends)
    whole, short = exact_runs(words, shingle), {}
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= shingle:
            out.append(np.unique(whole[a : b - shingle + 1]))
        else:
            out.append(np.array([len(whole) + short.setdefault(tuple(words[a:b].tolist()), len(short))]))
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    low = mix(hashes).astype(np.uint32)
    least = np.full(len(_MULTIPLY), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(low), 256):
        np.minimum(least, (low[k : k + 256, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return least


def signature(least: np.ndarray) -> bytes:
    """The low bytes of the first minima, which are compared one after another."""
    return least[:COMPARED].astype(np.uint8).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key of each band's minima."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For each step, the fewest equal low bytes with which the posterior of reaching the threshold is not below ``tolerance``.

    With a uniform prior, P(p >= t | m of n) is the probability that a
    binomial of n + 1 trials at t has m successes at most.
    """
    t = threshold + (1 - threshold) / 256  # low bytes agree by chance, too
    out = []
    for n in range(STEP, COMPARED + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def survivors(one: np.ndarray, others: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of ``others`` may reach the threshold with ``one`` (a row, or one for each)."""
    alive = np.arange(len(others))
    equal = np.zeros(len(others), dtype=np.int64)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        mine = one[part] if one.ndim == 1 else one[alive, part]
        equal[alive] += (others[alive, part] == mine).sum(axis=1)
        alive = alive[equal[alive] >= need]
        if not len(alive):
            break
    out = np.zeros(len(others), dtype=bool)
    out[alive] = True
    return out


def _forest(uids: np.ndarray, signs: np.ndarray, least: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the surviving pairs: each vertex meets only those not yet reached."""
    edges, todo = [], np.arange(len(uids))
    while len(todo):
        reached, todo = [todo[0]], todo[1:]
        root = uids[reached[0]]
        while reached and len(todo):
            hit = survivors(signs[reached.pop()], signs[todo], least)
            edges += [(int(u), int(root)) for u in uids[todo[hit]]]
            reached += todo[hit].tolist()
            todo = todo[~hit]
    return edges


def _bucket_edges(batches, least: list[int]):
    """Edges of the buckets, which come sorted by (key, i, j); a bucket may span batches."""

    def emit(key, uids, signs):
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        hit = survivors(signs[heads][group], signs, least)
        bad = np.zeros(len(heads), dtype=bool)
        bad[group[~hit]] = True
        bad &= np.diff([*heads, len(key)]) > 2
        good = hit & ~new & ~bad[group]
        edges = list(zip(uids[good].tolist(), uids[heads][group[good]].tolist(), strict=True))
        ends = [*heads[1:], len(key)]
        for g in np.flatnonzero(bad):
            edges += _forest(uids[heads[g] : ends[g]], signs[heads[g] : ends[g]], least)
        return edges

    def out(edges):
        edges = list(set(edges))
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    held = None
    for batch in batches:
        key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        uids = batch.column(3).to_numpy()
        signs = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, COMPARED)
        if held is not None:
            key, uids, signs = (np.concatenate(x) for x in zip(held, (key, uids, signs), strict=True))
        if not len(key):
            continue
        last = len(key) - int(np.argmax((key[::-1] != key[-1]).any(axis=1))) if (key != key[-1]).any() else 0
        held = (key[last:], uids[last:], signs[last:])
        if last:
            yield out(emit(key[:last], uids[:last], signs[:last]))
    if held is not None and len(held[0]):
        yield out(emit(*held))


def _in_blocks(rows: DataFrame, count: str, uid: str) -> DataFrame:
    """Rows dealt to pairs of blocks (columns i, j and mine): ``count`` blocks a group, every pair of rows meets in one of them."""
    mine = F.pmod(F.xxhash64(F.lit(count), F.col(uid)), F.col(count))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    dealt = rows.withColumn("mine", F.when(F.col(count) > 1, mine).otherwise(F.lit(0).cast("long"))).withColumn("other", other)
    return dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other")


def _verify(table: pa.Table, threshold: Fraction) -> pa.Table:
    """Exact links of a block, or between two: (uid, links, root) of each linked document."""
    order = np.argsort(table.column("uid").to_numpy(), kind="stable")
    uids, weights, mine = (table.column(c).to_numpy()[order] for c in ("uid", "copies", "mine"))
    words, signs = (table.column(c).take(order).to_pylist() for c in ("words", "sign"))
    i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
    sets = exact_sets(words)
    del words
    signs = np.frombuffer(b"".join(signs), np.uint8).reshape(-1, COMPARED)
    sizes = np.array([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.concatenate(sets)
    mark = np.zeros(codes.max() + 1, dtype=bool)
    links, root = np.zeros(len(sizes), dtype=np.int64), np.arange(len(sizes))
    least = least_matches(float(threshold))

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in range(len(sizes) - 1):
        others = np.arange(k + 1, len(sizes))
        if i != j:  # pairs within a block are counted in that block's own task
            others = others[mine[others] != mine[k]]
        small, large = np.minimum(sizes[others], sizes[k]), np.maximum(sizes[others], sizes[k])
        others = others[small * threshold.denominator >= large * threshold.numerator]
        others = others[survivors(signs[k], signs[others], least)] if len(others) else others
        if not len(others):
            continue
        own = codes[bounds[k] : bounds[k + 1]]
        mark[own] = True
        if others[-1] - others[0] + 1 == len(others):
            a, b = others[0], others[-1] + 1
            shared = np.add.reduceat(mark[codes[bounds[a] : bounds[b]]].astype(np.int32), bounds[a:b] - bounds[a])
        else:
            counts = sizes[others]
            ends = np.cumsum(counts)
            at = np.repeat(bounds[others] - (ends - counts), counts) + np.arange(ends[-1])
            shared = np.add.reduceat(mark[codes[at]].astype(np.int32), ends - counts)
        mark[own] = False
        others = others[shared * threshold.denominator >= (sizes[k] + sizes[others] - shared) * threshold.numerator]
        links[k] += weights[others].sum()
        links[others] += weights[k]
        for other in others[root[others] != root[k]]:
            a, b = top(k), top(other)
            root[max(a, b)] = root[other] = min(a, b)
    found = np.flatnonzero(links)
    return pa.table({"uid": pa.array(uids[found], pa.int64()), "links": pa.array(links[found]), "root": pa.array(uids[[top(k) for k in found]] if len(found) else [], pa.int64())})


class Join:
    """The steps of the join over one table."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: str = THRESHOLD, part_bytes: int = PART_BYTES, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES):
        self.spark, self.key, self.text = docs.sparkSession, key, text
        self.threshold, self.block_rows, self.block_bytes = Fraction(threshold), block_rows, block_bytes
        self.schema, self.parts = docs.schema, write_parts(docs, text, part_bytes)
        self.classes()
        self.verified()

    def classes(self) -> None:
        """Classes of equal sets from narrow rows; signatures of their representatives, part by part, never shuffled."""
        key, text = self.key, self.text

        def run(part, path, _):
            table = read_part(path)
            ids, texts = table.column(key).cast(pa.int64()), [t or b"" for t in binary(table.column(text))]
            for a, b in steps(texts):  # of bounded bytes, however long the texts
                rows = []
                for k, (own, second) in enumerate(shingle_sets(texts[a:b]), a):
                    sums = [int(mix(x).sum(dtype=np.uint64).astype(np.int64)) for x in (own, second)]
                    rows.append((part * PART_ROWS + k, ids[k].as_py(), *sums, len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["uid", "id", "h1", "h2", "n"])

        self.all = saved(each_part(self.parts, run, "uid long, id long, h1 long, h2 long, n long"), "shingled")
        groups = self.all.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("uid").alias("rep"), F.count("*").alias("copies"), F.min("id").alias("least"))
        self.reps = saved(groups, "classes")
        asked = self.reps.groupBy(F.shiftright("rep", PART_BITS).alias("part")).agg(F.collect_list((F.col("rep") % PART_ROWS).cast("int")).alias("rows"))

        def sign(part, path, got):
            texts, rows = binary(read_part(path).column(text)), sorted(got["rows"])
            for a, b in steps([texts[r] or b"" for r in rows]):
                least = [minima(own) for own, _ in shingle_sets([texts[r] for r in rows[a:b]])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part * PART_ROWS + r for r in rows[a:b]], pa.int64()), pa.array(map(signature, least), pa.binary()), pa.array([band_keys(x) for x in least], pa.list_(pa.int64()))], names=["rep", "sign", "bands"]
                )

        self.signs = saved(each_part(self.parts, sign, "rep long, sign binary, bands array<long>", saved(asked, "asked"), only=True), "signs")

    def candidates(self) -> DataFrame:
        """Edges (a, b) between representatives, a forest for each bucket; of buckets with the same members one is looked at."""
        keys = self.signs.select(F.col("rep").alias("uid"), F.explode("bands").alias("key"))
        # Saved, so that both sides of the join are dealt out for it alone, which lets Spark split a frequent key.
        several = saved(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "several")
        members = saved(keys.join(several.hint("merge"), "key"), "buckets")
        lanes = [F.bit_xor(F.xxhash64(F.lit(k), "uid")).alias(f"x{k}") for k in (0, 1)]
        one = members.groupBy("key", "m").agg(*lanes).groupBy("m", "x0", "x1").agg(F.min("key").alias("key")).select("key")
        members = members.join(one, "key").withColumn("blocks", F.ceil(F.col("m") / self.block_rows)).join(self.signs.select(F.col("rep").alias("uid"), "sign"), "uid")
        dealt = _in_blocks(members, "blocks", "uid").select("key", "i", "j", "uid", "sign")
        least = least_matches(float(self.threshold))
        sorted_rows = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "uid")
        return sorted_rows.mapInArrow(lambda batches: _bucket_edges(batches, least), "a long, b long").distinct()

    def _blocks(self) -> Column:
        """Blocks of a group of m rows with ``total`` shingles."""
        return F.greatest(F.ceil(F.col("m") / self.block_rows), F.ceil(F.col("total") * 8 / self.block_bytes))

    def _met(self, member: DataFrame) -> DataFrame:
        """``member`` with ``others``: its own block, and those in which some other row of its component shares a bucket with it.

        From narrow rows; texts go to these blocks alone. So of k rows that all
        share a bucket each goes to all blocks there are, and a row of a chain
        to no more than it has neighbours, by one rule for components of any size.
        """
        several = member.where("blocks > 1")
        if several.isEmpty():
            return member.withColumn("others", F.array("mine"))
        rows = saved(several.join(self.signs, "rep").select("component", "rep", "mine", F.explode("bands").alias("key")), "keys")
        # Saved, so that both sides of the join are dealt out for it alone, which lets Spark split a frequent bucket.
        seen = saved(rows.groupBy("component", "key").agg(F.collect_set("mine").alias("seen"), F.count("*").alias("m")).where("m > 1").drop("m"), "seen")
        met = rows.join(seen.hint("merge"), ["component", "key"]).select("rep", F.explode(F.array_union("seen", F.array("mine"))).alias("other"))
        met = saved(met.distinct().groupBy("rep").agg(F.collect_set("other").alias("found")), "met")
        return member.join(met, "rep", "left").withColumn("others", F.array_union(F.coalesce("found", F.array("mine")), F.array("mine"))).drop("found")

    def verified(self) -> None:
        """(rep, links, root) of each representative with a link; links counts documents."""
        member = components(self.candidates()).withColumnRenamed("vertex", "rep").withColumnRenamed("root", "component")
        member = member.join(self.reps.select("rep", "n", "copies"), "rep")
        size = member.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
        member = member.join(size.select("component", self._blocks().cast("long").alias("blocks")), "component")
        mine = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64(F.lit("blocks"), "rep"), "blocks")).otherwise(F.lit(0).cast("long"))
        member = saved(member.withColumn("mine", mine), "members")
        place = F.struct((F.col("rep") % PART_ROWS).alias("place"), "component", "mine", "others", "copies")
        asked = self._met(member).groupBy(F.shiftright("rep", PART_BITS).alias("part")).agg(F.collect_list(place).alias("rows"))  # rows of one part
        text = self.text

        def run(part, path, got):
            texts = binary(read_part(path).column(text))
            rows = got["rows"]
            for a, b in steps([texts[r["place"]] for r in rows]):
                own = rows[a:b]
                words = [b" ".join(texts[r["place"]].translate(NORMAL).split()) for r in own]
                signs = [signature(minima(one)) for one, _ in shingle_sets(words)]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([r[c] for r in own], pa.int64()) for c in ("component", "mine", "copies")], pa.array([r["others"] for r in own], pa.list_(pa.int64())), pa.array([part * PART_ROWS + r["place"] for r in own], pa.int64()), pa.array(signs, pa.binary()), pa.array(words, pa.binary())],
                    names=["component", "mine", "copies", "others", "uid", "sign", "words"],
                )

        texts = each_part(self.parts, run, "component long, mine long, copies long, others array<long>, uid long, sign binary, words binary", saved(asked, "asked"), only=True)
        dealt = texts.withColumn("other", F.explode("others")).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("others", "other")
        threshold = self.threshold
        found = saved(dealt.groupBy("component", "i", "j").applyInArrow(lambda t: _verify(t, threshold), "uid long, links long, root long").where("uid IS NOT NULL"), "verified")
        roots = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
        links = found.groupBy("uid").agg(F.sum("links").alias("links"))
        self.found = saved(links.join(roots.withColumnRenamed("vertex", "uid"), "uid").withColumnRenamed("uid", "rep"), "links")

    def linked_classes(self) -> DataFrame:
        """h1, h2, n, root, links and copies of each class of equal sets, and the least id in it."""
        classes = self.reps.select("h1", "h2", "n", "rep", "copies", "least").join(self.found, "rep", "left")
        return classes.select("h1", "h2", "n", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "copies", "least")

    def rows(self) -> DataFrame:
        """id, class_id, n_links and class_size of each document."""
        classes = saved(self.linked_classes(), "linked")
        # Saved, so that the join with it is one that Spark may split where a root is very frequent.
        names = saved(classes.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")), "names")
        named = classes.select("h1", "h2", "n", "root", F.col("links").alias("n_links")).join(names, "root").drop("root")
        own = self.all.select("id", "h1", "h2", "n")
        some = own.where("n > 0").join(saved(named, "named"), ["h1", "h2", "n"]).select("id", "class_id", "n_links", "class_size")
        return some.union(own.where("n = 0").select("id", "id", F.lit(0).cast("long"), F.lit(1).cast("long")))

    def first_of_each(self) -> DataFrame:
        """The uid of the document with the least id of each class (null ids last, then the least uid)."""
        roots = saved(self.linked_classes().select("h1", "h2", "n", "root"), "roots")
        own = self.all.select("uid", "id", "h1", "h2", "n")
        first = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "uid")).alias("x")
        # Of each class of equal sets one goes on; that count is map-side.
        some = own.where("n > 0").groupBy("h1", "h2", "n").agg(first).join(roots, ["h1", "h2", "n"]).groupBy("root").agg(F.min("x").alias("x"))
        return some.select("x.uid").union(own.where("n = 0").select("uid"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, class_id (the least key of the documents linked directly or through others), n_links (other documents linked directly, copies among them) and class_size of each row."""
    found = Join(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id", "text", **options)
    return found.rows().withColumnRenamed("id", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: that of the least key; same columns."""
    found = Join(docs, key, text, **options)
    kept = found.first_of_each().groupBy(F.shiftright("uid", PART_BITS).alias("part")).agg(F.sort_array(F.collect_list(F.col("uid") % PART_ROWS)).alias("rows"))

    def run(part, path, got):
        table = read_part(path)
        for a in range(0, len(got["rows"]), 512):
            yield from table.take(pa.array(got["rows"][a : a + 512])).combine_chunks().to_batches()

    return each_part(found.parts, run, docs.schema, saved(kept, "kept"), only=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m * 10 >= (x.n + y.n - m) * 8),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT d.doc_id, least(d.doc_id, min(b)) AS class_id FROM d LEFT JOIN r ON a = d.doc_id GROUP BY d.doc_id),
e AS (SELECT doc_id, coalesce(class_id, doc_id) AS class_id FROM c)
SELECT e.doc_id, class_id, coalesce(k, 0)::BIGINT AS n_links, count(*) OVER (PARTITION BY class_id) AS class_size
FROM e LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) ON a = e.doc_id
"""


def brute_force(rows: list[tuple[int | None, str | None]], threshold: str = THRESHOLD) -> list[tuple[int | None, int | None, int, int]]:
    """The definition, for tests."""
    t = Fraction(threshold)
    sets = []
    for _, text in rows:
        words = (text or "").encode().translate(NORMAL).split()
        sets.append({tuple(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    having: dict = {}
    for k, s in enumerate(sets):
        for other in sorted({o for g in s for o in having.get(g, ())}):
            both = len(s & sets[other])
            if both * t.denominator >= len(s | sets[other]) * t.numerator:
                links[k] += 1
                links[other] += 1
                a, b = top(k), top(other)
                root[max(a, b)] = min(a, b)
        for g in s:
            having.setdefault(g, []).append(k)
    tops = [top(k) for k in range(len(rows))]
    least: dict = {}
    for (i, _), r in zip(rows, tops, strict=True):
        known = least.setdefault(r, [None, 0])
        known[0] = i if known[0] is None else known[0] if i is None else min(i, known[0])
        known[1] += 1
    return [(i, least[r][0], n, least[r][1]) for (i, _), r, n in zip(rows, tops, links, strict=True)]
