import random

import numpy as np
import pytest

from siftnet.llm import toxicity


def maximal(values):
    """By definition: the best segment, then the same on both sides of it; the shortest among equals."""
    out = []

    def search(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += values[j]
                if total > 1e-9 and (best is None or total > best[0] + 1e-9 or (abs(total - best[0]) <= 1e-9 and j - i < best[2] - best[1])):
                    best = (total, i, j)
        if best:
            out.append((best[1], best[2], round(best[0], 6)))
            search(lo, best[1])
            search(best[2] + 1, hi)

    search(0, len(values))
    return sorted(out)


def test_segments_equal_the_definition():
    for seed in range(400):
        rng = random.Random(seed)
        values = [rng.choice([0.4, 1.1, 2.7]) + rng.random() if rng.random() < 0.35 else -0.5 for _ in range(rng.randint(0, 28))]
        at = np.array([i for i, v in enumerate(values) if v > 0], int)
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(at, np.array([values[i] for i in at]))]
        assert got == maximal(values)


def test_segments_are_linear():
    at = np.arange(0, 2_000_000, 10)
    assert len(toxicity.segments(at, np.full(len(at), 1.0))) == len(at)


def test_balance():
    shares, scores = np.array([0.01, 0.002]), np.array([2.0, 4.0])
    x = toxicity.balance(shares, scores)
    assert x > 0 and abs((shares * np.exp(x * scores)).sum() + (1 - shares.sum()) * np.exp(-x * toxicity.DRIFT) - 1) < 1e-6


@pytest.fixture(scope="module")
def fitted(spark):
    at = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{at}/labels.parquet")
    return toxicity.fit(docs, labels), docs, labels


def test_held_out_accuracy(fitted):
    model, docs, labels = fitted
    rows = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    hit = sum(r.toxic and r.predicted for r in rows)
    assert hit >= 0.9 * sum(r.toxic for r in rows)
    assert hit >= 0.95 * sum(r.predicted for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_edge_cases(spark, fitted):
    model = fitted[0]
    rows = [(1, None, 1.5), (2, "", 2.5), (None, "idiot", 0.0), (4, "plain words " * 20_000, 1.0), (1, None, 1.5)]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score double"), model)
    got = out.collect()
    assert len(got) == 5 and out.columns == ["doc_id", "text", "held_out", "score", "predicted", "passages"]
    none = model.score(0.0)
    assert all(r.score == none and r.predicted == 0 and r.passages == [] for r in got if r.doc_id is not None)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, model).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    for rows in ([], [(1, None), (None, 1)], [(1, 1), (2, 1)], [(1, 0), (1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert [r.score for r in toxicity.toxic_passages(docs, labels).collect()] == [0.0, 0.0]


def test_the_id_and_label_are_no_input(spark, fitted):
    model, docs, _ = fitted
    some = docs.limit(200)
    a = sorted(r.score for r in toxicity.score(some, model).collect())
    b = sorted(r.score for r in toxicity.score(some.selectExpr("doc_id * 7 + 3 AS doc_id", "text"), model).collect())
    assert a == b
