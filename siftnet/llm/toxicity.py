"""Toxic passages as maximum-scoring segments of token log-odds.

Fit, on a bounded sample of labelled rows (``SAMPLE_ROWS`` documents, chosen by hash of doc_id, labels with crc32(doc_id) mod 5 = 0 left
out): three quarters of the sample give each feature of a token, the whole word and its beginnings of some lengths, its log-odds
between toxic and clean documents, with a Dirichlet prior proportional to its overall frequency. A token scores the largest log-odds of
its features that are at least ``BOUND`` standard deviations above 0; every token pays a constant, so a scan drifts down outside
toxic passages. The last quarter calibrates.

Score, on every whole text: one linear scan finds all maximal segments. A segment's score becomes a p-value by the extreme-value law
1 - exp(-K * words * exp(-lambda * score)); lambda solves the balance equation of the background token scores, K is its
maximum-likelihood value on clean documents. The strengths (-ln p) of the significant segments of a document are added up and
a logistic curve, fitted on the calibration quarter, turns the sum into a score from 0 to 1.

Rows and edge cases: null and empty texts have no token and get the score of a document without a toxic passage; labels that
are null or have no doc_id are not used, of several labels of a document the largest counts; without labels of both classes all scores
are 0; rows with a null doc_id are scored and count as not held out. Input columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftnet.llm.words import Words, per_chunk, run_hashes, signed, split, without

#: Most labelled documents that the model is fitted on.
SAMPLE_ROWS = 20_000
#: Pseudo-counts of the Dirichlet prior as a share of all counts; least standard deviations above 0; cost of every token.
PRIOR, BOUND, DRIFT = 0.1, 4.0, 0.5
#: Lengths in bytes of the beginnings of words that are features besides the whole words.
BEGINNINGS = (5, 6, 7, 8)
#: Largest chance, in a clean document, of a segment that still counts.
SIGNIFICANT = 0.05
ADDED = ("held_out", "score", "predicted", "passages")

#: Tokens are runs of ASCII letters and digits (lower-cased) and of bytes beyond ASCII.
TOKEN_END = np.ones(256, bool)
TOKEN_END[0x30:0x3A] = TOKEN_END[0x41:0x5B] = TOKEN_END[0x61:0x7B] = False
TOKEN_END[0x80:] = False

_PASSAGES = T.ArrayType(
    T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("p_value", T.DoubleType())])
)


@dataclass(frozen=True)
class Model:
    """Hashes of the features with a positive score (ascending) and their scores; the extreme-value law; the logistic curve."""

    tokens: np.ndarray
    scores: np.ndarray
    scale: float = 1.0
    size: float = 1.0
    slope: float = 0.0
    offset: float = -math.inf

    def score(self, strength: float) -> float:
        z = self.slope * strength + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def p_value(self, score: float, words: int) -> float:
        return -math.expm1(-self.size * words * math.exp(-self.scale * score))


def held_out():
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def segments(places: np.ndarray, scores: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence that scores -drift outside the given places.

    ``scores`` are the whole scores at ``places``, all positive. Each place is pushed once, and leaves the stack once: for good when a
    later segment starts no higher than it does, or into a segment that grows over it.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before first, sum up to last, len(passed) then
    passed: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for place, score in zip(places.tolist(), scores.tolist()):
        before = total - drift * (place - last - 1)
        total, last = before + score, place
        first = place
        while stack:
            if stack[-1][2] >= before:
                passed.append(stack.pop())
            elif stack[-1][3] >= total:
                break
            else:
                first, _, before, _, mark = stack.pop()
                del passed[mark:]
        stack.append((first, place, before, total, len(passed)))
    return [(first, end, high - low) for first, end, low, high, _ in sorted(passed + stack)]


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, fit): the bounded sample. Only ids are sorted; texts are picked by a broadcast of at most SAMPLE_ROWS ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    return rows.select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) > 0).alias("fit"))


def _features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, hashes): the whole words, and their beginnings where they are longer; lengths enter the hash."""
    values = words.data.astype(np.uint64) + np.uint64(1)
    found = [(np.arange(len(words.starts)), words.hashes())]
    for length in BEGINNINGS:
        longer = np.flatnonzero(words.ends - words.starts > length)
        starts = words.starts[longer]
        found.append((longer, run_hashes(values, starts, starts + length) ^ np.uint64(length)))
    return found


def _lookup(features: np.ndarray, scores: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that the model scores, and their scores: the largest of a word's features."""
    if not len(features) or not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0)
    best = np.zeros(len(words.starts))
    for numbers, hashes in _features(words):
        at = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
        hit = features[at] == hashes
        best[numbers[hit]] = np.maximum(best[numbers[hit]], scores[at[hit]])
    places = np.flatnonzero(best)
    return places, best[places]


def _log_odds(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the scoring features, ascending, and their scores."""

    def count(batch, data, bounds):
        words = split(data, bounds, lower=True, separator=TOKEN_END)
        owner, toxic = words.owner(), batch.column("toxic").to_numpy()
        pairs = [np.stack([owner[numbers].astype(np.uint64), hashes]) for numbers, hashes in _features(words)]
        rows = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return pa.record_batch({"h": signed(np.ascontiguousarray(rows[1])), "toxic": toxic[rows[0].astype(np.int64)].astype(np.int32)})

    counted = per_chunk(sample.where("fit"), "h long, toxic int", count)
    per_feature = counted.groupBy("h").agg(F.sum("toxic").alias("y1"), F.sum(1 - F.col("toxic")).alias("y0"))
    n1, n0 = per_feature.agg(F.sum("y1"), F.sum("y0")).first()
    if not n1 or not n0:
        return np.zeros(0, np.uint64), np.zeros(0)
    mass = PRIOR * (n1 + n0)
    prior = F.lit(PRIOR) * (F.col("y1") + F.col("y0"))
    scored = per_feature.withColumn("prior", prior).select(
        "h",
        (
            F.log((F.col("y1") + F.col("prior")) / (n1 + mass - F.col("y1") - F.col("prior")))
            - F.log((F.col("y0") + F.col("prior")) / (n0 + mass - F.col("y0") - F.col("prior")))
        ).alias("odds"),
        F.sqrt(1 / (F.col("y1") + F.col("prior")) + 1 / (F.col("y0") + F.col("prior"))).alias("deviation"),
    )
    # few features of a bounded sample stand out; those are the model
    found = scored.where((F.col("odds") >= BOUND * F.col("deviation")) & (F.col("odds") > DRIFT)).collect()
    h = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["odds"] for r in found])[order] - DRIFT


def _background(sample: DataFrame, features: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of each score among the words of clean documents, and the scores."""

    def count(batch, data, bounds):
        words = split(data, bounds, lower=True, separator=TOKEN_END)
        value, n = np.unique(np.append(_lookup(features, scores, words)[1], 0.0), return_counts=True)
        n[0] += len(words.starts) - n.sum()
        return pa.record_batch({"value": value, "n": n.astype(np.int64)})

    rows = per_chunk(sample.where("fit AND toxic = 0"), "value double, n long", count).groupBy("value").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in rows) or 1
    kept = [r for r in rows if r["value"] > 0]
    # scores never met in clean text still have some share of it
    shares = [max(r["n"] / total, 1e-9) for r in kept] + [1e-9] * len(scores)
    return np.array(shares), np.array([r["value"] for r in kept] + scores.tolist())


def balance(shares: np.ndarray, scores: np.ndarray, drift: float = DRIFT) -> float:
    """The positive lambda with sum of share * exp(lambda * score) = 1, the rest of the shares scoring -drift."""
    rest = 1 - shares.sum()

    def excess(x: float) -> float:
        return float((shares * np.exp(np.minimum(x * scores, 600))).sum() + rest * math.exp(-x * drift) - 1)

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps with a slight pull to 0."""
    w = np.zeros(2)
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - 0.01 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -4, 4)
        if abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = _sample(docs, labels)
    tokens, scores = _log_odds(sample)
    empty = Model(tokens, scores)
    if not len(tokens):
        return empty
    scale = balance(*_background(sample, tokens, scores))

    def strongest(batch, data, bounds):
        words = split(data, bounds, lower=True, separator=TOKEN_END)
        places, values = _lookup(tokens, scores, words)
        edges = np.searchsorted(places, words.firsts)
        found = [[s for _, _, s in segments(places[a:b], values[a:b])] for a, b in zip(edges[:-1], edges[1:])]
        return pa.record_batch({"toxic": batch.column("toxic"), "n": words.counts.astype(np.int64), "found": pa.array(found, pa.list_(pa.float64()))})

    rows = per_chunk(sample.where("NOT fit"), "toxic int, n long, found array<double>", strongest).collect()
    clean = [r for r in rows if not r["toxic"] and r["n"]]
    if not clean or len(clean) == len(rows):
        return empty
    size = len(clean) / sum(r["n"] * math.exp(-scale * max(r["found"], default=0.0)) for r in clean)
    model = Model(tokens, scores, scale, size)
    x = np.array([_strength(model, r["found"], r["n"]) for r in rows])
    slope, offset = _logistic(x, np.array([float(r["toxic"]) for r in rows]))
    return Model(tokens, scores, scale, size, slope, offset)


def _strength(model: Model, found: list[float], words: int) -> float:
    """Sum of -ln p of the significant segments."""
    values = [max(model.p_value(s, words), 1e-30) for s in found]
    return -sum(math.log(p) for p in values if p <= SIGNIFICANT)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with held_out, score, predicted and passages (first word, words and p-value of each significant segment)."""
    docs = without(docs, *ADDED).withColumn("held_out", held_out())
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", _PASSAGES)]
    )

    def rate(batch, data, bounds):
        words = split(data, bounds, lower=True, separator=TOKEN_END)
        places, values = _lookup(model.tokens, model.scores, words)
        edges = np.searchsorted(places, words.firsts)
        none = model.score(0.0)
        scores, passages = [none] * len(words.counts), [[]] * len(words.counts)
        for i in np.flatnonzero(np.diff(edges)):
            a, b = edges[i], edges[i + 1]
            n, first = int(words.counts[i]), int(words.firsts[i])
            found = segments(places[a:b] - first, values[a:b])
            scores[i] = model.score(_strength(model, [s for _, _, s in found], n))
            passages[i] = [
                {"first_word": lo, "n_words": hi - lo + 1, "p_value": p} for lo, hi, s in found if (p := model.p_value(s, n)) <= SIGNIFICANT
            ]
        columns = {name: batch.column(name) for name in batch.schema.names}
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("p_value", pa.float64())]))
        return pa.record_batch(
            columns | {"score": scores, "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32()), "passages": pa.array(passages, kind)}
        )

    return per_chunk(docs, schema, rate)


def toxic_passages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows of ``docs`` that are not held out, and score all."""
    return score(docs, fit(docs, labels))
