"""Soft-membership mixing: document rates whose expected domain token totals match targets.

A domain is a class of the labelled table (clean, low, toxic). A softmax
regression over n-grams (words, and runs of letters at words' heads), of which a
document has some and lacks the rest, scores each document for each domain; they
are looked up by their hashes. A second one, over bins of these scores and of a few statistics, turns
them into posteriors. The first is learned from one half of the labelled sample
and the second from the other, so the posteriors are not those of n-grams already
seen; with a weight for each bin and no penalty on the intercepts, the expected
number of documents of each domain equals the labelled one. Rates are a least-squares fit of the expected domain
token totals to their targets, by projected gradient steps from rate 1 on:

    miss_k = sum_d w_d r_d p_dk - t_k,    r_d <- min(cap, max(0, r_d - p_d . H miss))

with w the documents' token shares. H, the inverse Gram matrix of the posteriors
of documents whose rate isn't 0, is the metric of the step; with it a few steps
are enough where plain gradients need hundreds. A step needs only the domains'
misses and that matrix, so each is one aggregation of a narrow table, and a
document's rate is an expression in its own posterior: no state is kept for each
document, and nothing but a few sums reaches the driver.

No rate is above 1 unless the caller asks for it, so a mixture holds no document
more often than the input. Targets that are not met are said so: by
``Rates.miss``, by a column of the query, and by :func:`mix` as its caller wants:
by a column, an error or a warning.

Everything is DataFrame expressions; no text is shuffled.

Defined results: a null or empty text has no tokens and rate like any other of
its posterior, a very long one is one array of words at a time; documents with
null or unknown ids are rated, but not learned from; repeated rows are rated
each, and get the same rate; null labels are not learned from; a domain that no
document belongs to has its target given to the others; without labels all
belong to the first domain; an empty table gives an empty one; of n-grams equally
far from chance those of the least hash are taken. Extra columns pass through :func:`mix`, whatever
their names.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._shared import saved

DOMAINS = ("clean", "low", "toxic")
#: Target shares of the mixture's tokens.
TARGETS = {"clean": 0.93, "low": 0.05, "toxic": 0.02}
#: The same where clean documents stay whole: toxic ones are thinned, the rest is left.
CLEAN_TARGETS = {"clean": 0.98, "toxic": 0.02}
#: The classifier is learned from so many labelled documents at most, those of the least hash.
SAMPLE_ROWS = 20_000
#: Slots in which n-grams with weights are looked up, and letters at a longer word's head that are an n-gram of their own.
SLOTS, HEAD = 1 << 14, 5
#: Penalty on an n-gram's weight, in documents; n-grams of a domain at most, the documents and the standard deviations from chance one has at least.
NGRAM_PENALTY, NGRAMS, LEAST_DOCUMENTS, DEVIATIONS = 1.0, 300, 4, 3.5
#: Penalty on the classifier's weights, in documents.
PENALTY = 0.5
#: Of the domain that limits a mixture without copies, the share that is kept, so that all targets can be met.
SLACK = 0.95
#: Share of the domains' masses added to the metric; steps at most; largest miss of a target, as a share of it, that ends them.
DAMPING, STEPS, TOLERANCE = 1e-5, 30, 1e-3
#: Bin edges of the statistics (fixed values).
EDGES = {
    "tokens": [10, 30, 100, 300, 1000, 3000],
    "symbols": [0.01, 0.05, 0.2, 0.6, 1.5],
    "capitals": [0.05, 0.15, 0.3, 0.6],
    "distinct": [0.1, 0.25, 0.4, 0.55, 0.7, 0.85],
    "low": [-8.0, -5.0, -3.0, -1.5, 0.0, 1.5, 3.0, 6.0],
    "toxic": [-6.0, -4.0, -3.0, -2.0, -1.0, 0.0, 2.0, 4.0],
}


def _words(text: str) -> Column:
    plain = F.coalesce(F.col(text), F.lit(""))
    for mark in "\n.,":
        plain = F.replace(plain, F.lit(mark), F.lit(" "))
    return F.filter(F.split(F.lower(plain), " "), lambda w: w != "")


def domain() -> Column:
    """A labelled row's domain, null if its labels are."""
    return F.when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 0) & (F.col("toxic") == 0), "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")


def labelled(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """_id, _domain and _half of the labelled sample."""
    known = labels.select(F.col("doc_id").alias("_id"), domain().alias("_domain")).where("_id IS NOT NULL AND _domain IS NOT NULL")
    order = F.xxhash64("_id")
    return known.orderBy(order, "_id", "_domain").limit(sample_rows).withColumn("_half", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)))


def _head(word: Column) -> Column:
    return F.substring(word, 1, HEAD)


def _constant(values, kind: str) -> Column:
    """An array that is read when the plan is made, not at each row."""
    return F.split(F.lit(",".join(values)), ",").cast(f"array<{kind}>")


def _key(kind: str, text: Column) -> Column:
    return F.xxhash64(F.lit(kind), text)


@dataclass
class Ngrams:
    """Scores of the domains after the first, relative to it: an intercept each, and weights of the n-grams, which are words or heads of longer words."""

    prior: list[float] = field(default_factory=lambda: [0.0] * (len(DOMAINS) - 1))
    grams: list[tuple[str, str]] = field(default_factory=list)  #: ("word" or "head", text)
    keys: list[int] = field(default_factory=list)  #: their hashes
    weights: list[list[float]] = field(default_factory=list)

    def marked(self) -> Column:
        """Those of the column ``_words`` that are, or begin with, one of the n-grams, each once."""
        words, heads = ([t for k, t in self.grams if k == kind] for kind in ("word", "head"))
        if not self.grams:
            return F.expr("cast(array() as array<string>)")
        return F.array_distinct(F.filter("_words", lambda w: w.isin(words) | _head(w).isin(heads)))

    def found(self) -> Column:
        """Numbers (from 1) of the n-grams a document has, by the column ``_marked``. A slot tells which n-gram may be meant; its hash tells whether it is."""
        if not self.grams:
            return F.expr("cast(array() as array<int>)")
        slots = [0] * SLOTS
        for k, key in enumerate(self.keys, 1):
            slots[key % SLOTS] = k
        slot, own = _constant(map(str, slots), "int"), _constant(map(str, [0, *self.keys]), "bigint")
        heads = F.transform(F.filter("_marked", lambda w: F.length(w) > HEAD), lambda w: _key("head", _head(w)))
        held = F.transform(F.concat(F.transform("_marked", lambda w: _key("word", w)), F.array_distinct(heads)), lambda h: F.struct(h.alias("h"), F.get(slot, F.pmod(h, F.lit(SLOTS)).cast("int")).alias("k")))
        return F.transform(F.filter(held, lambda x: (x["k"] > 0) & (F.get(own, x["k"]) == x["h"])), lambda x: x["k"])

    def score(self, k: int) -> Column:
        """The score of domain k + 1, an expression over the column ``_found``."""
        if not self.grams:
            return F.lit(float(self.prior[k]))
        table = _constant((f"{w:.6g}" for w in [0.0, *self.weights[k]]), "double")
        return F.aggregate("_found", F.lit(float(self.prior[k])), lambda a, b: a + F.get(table, b))


def chosen_grams(sample: DataFrame, total: dict[str, int], most: int = NGRAMS) -> list[tuple[str, str, int]]:
    """(kind, text, hash) of the n-grams that mark a domain: of each the ``most`` whose documents are in it more or less often than by chance, by more than ``DEVIATIONS``."""
    distinct = F.array_distinct("_words")
    heads = F.array_distinct(F.transform(F.filter("_words", lambda w: F.length(w) > HEAD), _head))
    named = lambda kind, c: F.transform(c, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("text")))
    both = F.concat(named("word", distinct), named("head", heads))
    counts = sample.select("_domain", F.explode(both).alias("g")).groupBy("g.kind", "g.text").agg(*[F.count_if(F.col("_domain") == d).alias(d) for d in DOMAINS])
    seen = sum((F.col(d) for d in DOMAINS), F.lit(0))
    counts = saved(counts.where(seen >= LEAST_DOCUMENTS).withColumn("h", F.when(F.col("kind") == "word", _key("word", F.col("text"))).otherwise(_key("head", F.col("text")))), "gram-counts")
    n, found = sum(total.values()), {}
    for d in DOMAINS[1:]:
        rate = total[d] / n
        off = F.abs(F.col(d) - seen * rate) / F.sqrt(seen * (rate * (1 - rate)) + 1e-9)
        for r in counts.withColumn("off", off).where(F.col("off") > DEVIATIONS).orderBy(F.desc("off"), "h").limit(most).collect():
            known = found.get((r.kind, r.text), (0.0, r.h))
            found[r.kind, r.text] = (max(known[0], r.off), r.h)
    slots: dict[int, tuple[str, str, int]] = {}  # of a slot's n-grams the one farthest from chance
    for (kind, text), (_, h) in sorted(found.items(), key=lambda x: (-x[1][0], x[1][1])):
        slots.setdefault(h % SLOTS, (kind, text, h))
    return sorted(slots.values())


def learn_ngrams(docs: DataFrame, known: DataFrame, penalty: float = NGRAM_PENALTY, most: int = NGRAMS) -> Ngrams:
    """The sparse softmax regression over the n-grams of the labelled sample's documents.

    They are counted where they are; the driver gets the chosen ones, and their numbers in each of at most ``SAMPLE_ROWS`` documents.
    """
    sample = saved(docs.join(F.broadcast(known), docs["doc_id"] == known["_id"]).select("_domain", _words("text").alias("_words")), "sample")
    total = {d: 0 for d in DOMAINS} | {r["_domain"]: r["count"] for r in sample.groupBy("_domain").count().collect()}
    if not total[DOMAINS[0]] or not sum(total[d] for d in DOMAINS[1:]):
        return Ngrams()
    grams = chosen_grams(sample, total, most)
    model = Ngrams(grams=[g[:2] for g in grams], keys=[g[2] for g in grams])
    table = sample.withColumn("_marked", model.marked()).select("_domain", model.found().alias("f")).toArrow().combine_chunks()
    n, found = table.num_rows, table.column(1).combine_chunks()
    y = np.array([[d == x for d in DOMAINS] for x in table.column(0).to_pylist()], dtype=float)
    x = np.zeros((n, len(grams) + 1))
    x[:, 0] = 1
    x[np.repeat(np.arange(n), np.diff(found.offsets.to_numpy())), found.flatten().to_numpy()] = 1
    w = regression(x, y, np.ones(n), penalty)
    model.prior, model.weights = (w[0, 1:] - w[0, 0]).tolist(), (w[1:, 1:] - w[1:, :1]).T.tolist()
    return model


def _bin(value: Column, edges: list[float]) -> Column:
    """How many edges a value reaches; it is worked out once and then compared with them."""
    every = F.array(*[F.lit(float(e)) for e in edges])
    return F.aggregate(F.array(value), F.lit(0), lambda _, v: F.size(F.filter(every, lambda e: v >= e)))


def statistics(scores: Ngrams, text: str = "text") -> dict[str, Column]:
    """n_tokens and a bin of each statistic, as expressions over the columns ``_words`` and ``_found``."""
    n = F.size("_words").cast("long")
    per = F.greatest(n, F.lit(1)).cast("double")
    plain = F.coalesce(F.col(text), F.lit(""))
    values = {
        "tokens": n.cast("double"),
        "symbols": F.regexp_count(plain, F.lit(r"[#$%&*|!]")) / per,
        "capitals": F.regexp_count(plain, F.lit(r"[A-Z]")) / F.greatest(F.length(plain), F.lit(1)),
        "distinct": F.size(F.array_distinct("_words")) / per,
    } | {d: scores.score(k) for k, d in enumerate(DOMAINS[1:])}
    out = {"n_tokens": n}
    for name, value in values.items():
        out[f"b_{name}"] = _bin(value, EDGES[name])
    return out


@dataclass
class Classifier:
    """Logits: ``prior[k]`` and ``table[statistic][bin][k]``."""

    scores: Ngrams
    prior: list[float]
    table: dict[str, list[list[float]]] = field(default_factory=dict)

    def posteriors(self) -> list[Column]:
        """Expressions over the bins' columns; they sum to 1."""
        sums = []
        for k in range(len(DOMAINS)):
            total = F.lit(self.prior[k])
            for name in EDGES:
                total = total + F.element_at(F.array(*[F.lit(row[k]) for row in self.table[name]]), F.col(f"b_{name}") + 1)
            sums.append(total)
        return [1.0 / sum((F.exp(F.least(F.lit(700.0), other - own)) for other in sums), F.lit(0.0)) for own in sums]


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, rounds: int = 60) -> np.ndarray:
    """Weights (features, classes) of a softmax regression by Newton steps; column 0 of ``x`` is 1 and goes without a penalty.

    The first class with rows has weights 0; classes without rows are left out by an intercept of -1000.
    """
    n, d, k = len(x), x.shape[1], y.shape[1]
    out = np.zeros((d, k))
    have = [c for c in range(k) if (weight * y[:, c]).sum() > 0]
    out[0, [c for c in range(k) if c not in have]] = -1e3
    own = have[1:]
    if not own:
        return out
    ridge = np.full(d, penalty)
    ridge[0] = 1e-9

    def loss(w):
        z = x @ w
        top = z.max(axis=1, keepdims=True)
        return float((weight * ((np.log(np.exp(z - top).sum(axis=1, keepdims=True)) + top)[:, 0] - (z * y).sum(axis=1))).sum() + 0.5 * (ridge[:, None] * w[:, own] ** 2).sum())

    now = loss(out)
    for _ in range(rounds):
        z = x @ out
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = np.concatenate([x.T @ (weight * (p[:, c] - y[:, c])) + ridge * out[:, c] for c in own])
        curve = np.block([[(x * (weight * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x + (a == b) * np.diag(ridge + 1e-9) for b in own] for a in own])
        step, size = np.linalg.solve(curve, slope).reshape(len(own), d).T, 1.0
        while size > 1e-6:
            new = out.copy()
            new[:, own] -= size * step
            if (value := loss(new)) <= now:
                break
            size /= 2
        else:
            break
        done, out, now = now - value < 1e-9 * (1 + n), new, value
        if done:
            break
    return out


def learn(binned: DataFrame, known: DataFrame, scores: Ngrams) -> Classifier:
    """The regression over the bins of the labelled sample's documents, which are counted before they are collected."""
    rows = binned.join(F.broadcast(known), binned["doc_id"] == known["_id"])
    counted = rows.groupBy("_domain", *[f"b_{n}" for n in EDGES]).count().collect()  # SAMPLE_ROWS rows at most
    first, at = {}, 1
    for name, edges in EDGES.items():
        first[name], at = at, at + len(edges) + 1
    x, y = np.zeros((len(counted), at)), np.zeros((len(counted), len(DOMAINS)))
    x[:, 0] = 1
    for k, r in enumerate(counted):
        y[k, DOMAINS.index(r["_domain"])] = 1
        for name in EDGES:
            x[k, first[name] + r[f"b_{name}"]] = 1
    w = regression(x, y, np.array([float(r["count"]) for r in counted]))
    if not counted:
        w[0] = [0.0] + [-1e3] * (len(DOMAINS) - 1)
    return Classifier(scores, w[0].tolist(), {n: w[first[n] : first[n] + len(e) + 1].tolist() for n, e in EDGES.items()})


def with_bins(docs: DataFrame, scores: Ngrams, *keep: str) -> DataFrame:
    words = docs.withColumn("_words", _words("text")).withColumn("_marked", scores.marked()).withColumn("_found", scores.found())
    return words.select(*keep, *[c.alias(n) for n, c in statistics(scores).items()])


@dataclass
class Rates:
    """A document's rate as an expression in its posteriors."""

    steps: list[list[float]] = field(default_factory=list)
    cap: float = 1.0
    kept: list[int] = field(default_factory=list)  #: domains whose documents have rate 1
    miss: float = 0.0  #: the largest miss of a target, as a share of it

    def column(self, p: list[Column]) -> Column:
        """The steps one after another; they are one constant, so code compiled for one step serves all."""
        if not self.steps:
            return F.lit(1.0)
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in self.steps])
        rate = F.aggregate(steps, F.lit(1.0), lambda r, c: F.least(F.lit(float(self.cap)), F.greatest(F.lit(0.0), r - sum((x * c[k] for k, x in enumerate(p)), F.lit(0.0)))))
        return F.when(self.mostly(p), F.lit(1.0)).otherwise(rate) if self.kept else rate

    def mostly(self, p: list[Column]) -> Column:
        """Whether a document belongs to a domain that is kept before all others."""
        return F.greatest(F.lit(0.0), *[p[k] for k in self.kept]) >= F.greatest(F.lit(0.0), *[x for k, x in enumerate(p) if k not in self.kept])


def fit(posteriors: DataFrame, targets: dict[str, float], budget: float | None = None, keep: tuple[str, ...] = (), cap: float = 1.0, damping: float = DAMPING, steps: int = STEPS, tolerance: float = TOLERANCE) -> Rates:
    """Projected gradient over the table of posteriors (n_tokens, p_0, ...), with rates from 0 to ``cap``.

    Domains without a target are left as they come. Documents of ``keep`` have
    rate 1, and the other domains' targets are relative to these. ``budget`` is
    the mixture's size in tokens: by default the input's, or, where no rate may
    be above 1, the largest that its domains have tokens for (less ``SLACK``).
    """
    p = [F.col(f"p_{k}") for k in range(len(DOMAINS))]
    tokens = F.col("n_tokens").cast("double")
    kept = [k for k, d in enumerate(DOMAINS) if d in keep]
    sums = posteriors.agg(F.sum(tokens).alias("n"), *[F.sum(tokens * x).alias(f"m{k}") for k, x in enumerate(p)]).first()
    n = sums["n"] or 0.0
    shares = [(sums[f"m{k}"] or 0.0) / n if n else 0.0 for k in range(len(DOMAINS))]
    live = [s > 1e-9 and d in targets for d, s in zip(DOMAINS, shares, strict=True)]
    weight = [targets.get(d, 0.0) if ok else 0.0 for d, ok in zip(DOMAINS, live, strict=True)]
    if not n or sum(weight) <= 0:
        return Rates(cap=cap, kept=kept)
    weight = [w / sum(weight) for w in weight]
    most = min([s / w for s, w in zip(shares, weight, strict=True) if w > 0])
    size = budget / n if budget is not None else 1.0 if cap > 1 else 1.0 if most > 1 - 1e-9 else SLACK * most
    if kept and budget is None:
        size = max([shares[k] / weight[k] for k in kept if weight[k] > 0] or [1.0])
    goal = [w * size for w in weight]
    if kept:  # what is kept has no target of its own, and of the others no more is asked for than there is
        goal = [min(g, s) for g, s in zip(goal, shares, strict=True)]
        live = [ok and k not in kept for k, ok in enumerate(live)]
        if not any(live):
            return Rates(cap=cap, kept=kept)
    best, least, before, slow, size = Rates(cap=cap, kept=kept), math.inf, math.inf, 0, 1.0
    rates = Rates(cap=cap, kept=kept)
    direction = np.zeros(len(p))
    pairs = [(i, j) for i in range(len(p)) for j in range(i + 1)]
    for _ in range(steps):
        # Free is what isn't at a bound, or was just moved away from it.
        moved = F.aggregate(F.array(F.array(*[F.lit(float(d)) for d in direction])), F.lit(0.0), lambda a, c: a + sum((x * c[k] for k, x in enumerate(p)), F.lit(0.0)))  # a constant, as in Rates.column
        free = (F.col("_r") > 0) & ((F.col("_r") < cap) | (moved > 0)) if rates.steps else F.lit(True)
        free = F.when(free & ~rates.mostly(p) if kept else free, tokens).otherwise(0.0)
        now = posteriors.withColumn("_r", rates.column(p)).agg(*[F.sum(tokens * F.col("_r") * x).alias(f"s{k}") for k, x in enumerate(p)], *[F.sum(free * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
        gap = np.array([now[f"s{k}"] / n - g if ok else 0.0 for k, (g, ok) in enumerate(zip(goal, live, strict=True))])
        squares = sum(x * x / g for x, g, ok in zip(gap, goal, live, strict=True) if ok)
        if squares < least * (1 - 1e-6):
            miss = max(abs(x) / g for x, g, ok in zip(gap, goal, live, strict=True) if ok)
            best, least, size = Rates(list(rates.steps), cap, kept, miss), squares, 1.0
            slow = slow + 1 if squares > 0.95 * before else 0
            before = squares
            if miss < tolerance or slow == 3:  # met, or as near as rates within their bounds come
                break
            gram = np.zeros((len(p), len(p)))
            for i, j in pairs:
                gram[i, j] = gram[j, i] = now[f"g{i}_{j}"] / n
            own = np.flatnonzero(live)
            direction = np.zeros(len(p))
            direction[own] = np.linalg.solve((gram + damping * np.diag(np.maximum(shares, 1e-9)))[np.ix_(own, own)], gap[own])
        elif size > 0.02:
            size /= 2  # a step that made it worse is taken again, half as long
        else:
            break
        rates = Rates([*best.steps, [float(size * x) for x in direction]], cap, kept)
    return best


def prepared(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Classifier]:
    """The saved narrow table doc_id, n_tokens, p_0, ... of all documents, and the classifier."""
    docs = docs.select("doc_id", "text")
    known = saved(labelled(labels), "labelled")
    scores = learn_ngrams(docs, known.where("_half = 0"))
    binned = saved(with_bins(docs, scores, "doc_id"), "bins")
    model = learn(binned, known.where("_half = 1"), scores)
    return saved(binned.select("doc_id", "n_tokens", *[p.alias(f"p_{k}") for k, p in enumerate(model.posteriors())]), "posteriors"), model


def copies(rate: Column, key: Column) -> Column:
    """The rate rounded up or down by a number in [0, 1) that the key alone gives."""
    return F.floor(rate + F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 20)) / (1 << 20)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = CLEAN_TARGETS, keep: tuple[str, ...] = ("clean",), cap: float = 1.0, on_miss: str = "warn") -> DataFrame:
    """``docs``, each row as often as its rate says: never more than once with a ``cap`` of 1.

    Documents that belong to ``keep`` before all remain, once each, so targets
    that these alone go beyond are missed. ``on_miss``: what a target missed by
    more than ``TOLERANCE`` is: "error"; "warn"; or "column", a last column
    ``largest_miss``, met or not. Else the same columns; no shuffle.
    """
    if on_miss not in ("warn", "error", "column"):
        raise ValueError(f"on_miss {on_miss!r} is none of warn, error, column")
    table, model = prepared(docs, labels)
    rates = fit(table, targets, keep=keep, cap=cap)
    if rates.miss > TOLERANCE and on_miss != "column":
        said = f"a domain's expected tokens miss their target by {rates.miss:.1%} of it"
        if on_miss == "error":
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    names = {f"_c{k}": c for k, c in enumerate(docs.columns)}  # the caller's columns may be called as ours
    rows = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for n, c in names.items()])
    out = with_bins(rows, model.scores, "doc_id", *names)
    p = [F.col(f"_p{k}") for k in range(len(DOMAINS))]
    out = out.select("doc_id", *names, *[x.alias(f"_p{k}") for k, x in enumerate(model.posteriors())])
    times = copies(rates.column(p), F.col("doc_id"))
    # A generator even where no row is copied: a filter would be pushed below the statistics and have them counted again for each use.
    out = out.select(*names, F.explode(F.array_repeat(F.lit(0), times)).alias("_copy"))
    miss = [F.lit(float(rates.miss)).alias("largest_miss")] if on_miss == "column" else []
    return out.select(*[F.col(n).alias(c) for n, c in names.items() if not (miss and c == "largest_miss")], *miss)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    table, _ = prepared(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    p = [F.col(f"p_{k}") for k in range(len(DOMAINS))]
    rates = fit(table, TARGETS)
    out = table.select("doc_id", "n_tokens", *[x.alias(f"p_{d}") for d, x in zip(DOMAINS, p, strict=True)], rates.column(p).alias("rate"))
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id"))).withColumn("largest_miss", F.lit(float(rates.miss)))
