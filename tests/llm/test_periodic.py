import random

import numpy as np
import pytest

from siftnet.llm.periodic import PRIMES, find_runs, numbered, occurrences, periodic_runs, transform
from siftnet.llm.queries import op13_periodic_runs
from tests.llm import brute


def chunk(texts):
    parts = [" ".join(t).encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def found(texts, **kw):
    words, numbers = numbered(*chunk(texts))
    runs = find_runs(numbers, words.firsts, **kw)
    return [[(a - lo, b - a, q) for a, b, q in runs.tolist() if lo <= a < hi] for lo, hi in zip(words.firsts[:-1], words.firsts[1:])]


@pytest.mark.parametrize("prime,generator,order", PRIMES)
def test_transform_is_exact(prime, generator, order):
    assert prime < 1 << 31 and (prime - 1) % (1 << order) == 0 and pow(generator, (prime - 1) // 2, prime) == prime - 1
    rng = np.random.default_rng(1)
    for size in (2, 4, 64):
        rows = rng.integers(0, prime, (3, size)).astype(np.uint64)
        spread = transform(rows, prime, generator)
        root = pow(generator, (prime - 1) // size, prime)
        slow = [[sum(int(v) * pow(root, i * k, prime) for i, v in enumerate(row)) % prime for k in range(size)] for row in rows]
        assert spread.tolist() == slow
        assert transform(spread, prime, generator, inverse=True).tolist() == rows.tolist()


def test_occurrences_of_large_values():
    """Sums beyond one prime: differences that are multiples of it are no matches."""
    prime = PRIMES[0][0]
    values = np.array([1, 2, 1 + prime, 2, 1, 2, 5, 6], np.int64)
    at, d = occurrences(values, np.array([0]), np.array([8]), 2)
    assert (at.tolist(), d.tolist()) == ([], [])
    at, d = occurrences(np.concatenate([values[:2], [9], values[:2]]), np.array([0]), np.array([5]), 2)
    assert (at.tolist(), d.tolist()) == ([0], [3])


def test_equals_brute_force():
    rng = random.Random(5)
    for rep in range(40):
        texts = [[], ["a"], ["a"] * rng.randint(1, 200)]
        for k in range(8):
            text, alphabet = [], "ab" if k % 2 else "abcdefgh"
            while len(text) < rng.randint(0, 250):
                if rng.random() < 0.4:
                    text += [rng.choice(alphabet) for _ in range(rng.randint(1, 20))]
                else:
                    unit = [rng.choice(alphabet) for _ in range(rng.randint(1, 40))]
                    text += (unit * 10)[: int(len(unit) * rng.uniform(2, 9))]
            texts.append(text)
        assert found(texts) == [brute.periodic(t) for t in texts]
        assert found(texts, least=3, exponent=3) == [brute.periodic(t, 3, 3) for t in texts]


def test_long_texts_cost_no_square():
    """Runs whose every stretch is equal to every other; a binary sequence whose prefix hashes collide modulo 2**64."""
    assert found([["a"] * 100_000 + ["b"] + ["a"] * 100_000]) == [[(0, 100_000, 1), (100_001, 100_000, 1)]]
    assert len(found([(["a"] * 100 + ["b"]) * 1000])[0]) == 1001
    sequence = ["ab"[bin(i).count("1") & 1] for i in range(4096)]
    assert found([sequence * 20]) == [[(0, 81920, 4096)]]


def test_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for row in rows:
        words = brute.repeated_tail(row.doc_id, row.text)
        expected[row.doc_id] = brute.periodic_digests(words)
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in op13_periodic_runs(spark, sf_dir).collect()}
    assert got == expected
    assert sum(v[0] > 0 for v in got.values()) > 5


def test_edge_cases(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " \n\t ", 7), (4, "a  a\ta\na a a", 7), (4, "a a a a a a", 7), (None, "x " + "b c " * 4, 7), (5, "é " * 6 + "ß", 7), (6, "a a a a a", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, RUNS int")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()))
    assert got == [
        (0, 9, [(1, 8, 2)], "x b c"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 6, [(0, 6, 1)], "a"), (4, 6, [(0, 6, 1)], "a"),
        (5, 7, [(0, 6, 1)], "é ß"), (6, 5, [], "a a a a a"),
    ]
    assert periodic_runs(df).columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        found([["a"] * 9], exponent=2)
