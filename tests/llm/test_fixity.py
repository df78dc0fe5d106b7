import hashlib
import random

from siftnet.llm import fixity

SCHEMA = "archive long, offset long, content string"


def differences(a, b):
    digest = lambda c: hashlib.sha256((c or "").encode()).hexdigest()
    left, right = {(x, o): digest(c) for x, o, c in a}, {(x, o): digest(c) for x, o, c in b}
    out = []
    for k in sorted({*left, *right}):
        if left.get(k) != right.get(k):
            out.append((*k, "missing" if k not in right else "extra" if k not in left else "corrupt"))
    return out


def audited(spark, a, b, **kw):
    out = fixity.audit(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), **kw)
    return sorted((r.archive, r.offset, r.kind) for r in out.collect())


def test_locates_damage(spark):
    rng = random.Random(6)
    a = [(x, o * 37, f"record {x} {o} " * rng.randint(1, 4)) for x in range(3) for o in range(80 if x else 300)]
    b = [r for r in a if rng.random() > 0.02] + [(2, 10**7, "beyond the end"), (9, 0, "another archive")]
    b = [(x, o, c + "!" if rng.random() < 0.02 else c) for x, o, c in b]
    for kw in ({}, {"range_bytes": 200, "fan": 4}):
        assert audited(spark, a, b, **kw) == differences(a, b)


def test_only_mismatching_branches_are_descended(spark):
    a = [(1, o * 100, f"r{o}") for o in range(256)]
    b = [(x, o, "damaged" if o == 9900 else c) for x, o, c in a]
    hashes = [fixity.record_hashes(spark.createDataFrame(r, SCHEMA)) for r in (a, b)]
    trees = [fixity.tree(h, 2, range_bytes=1600, fan=4) for h in hashes]
    assert [fixity._differing(x, y).count() for x, y in zip(*trees)] == [1, 1, 1]
    assert [t.count() for t in trees[0]] == [16, 4, 1]


def test_edge_cases(spark):
    a = [(1, 0, None), (1, 5, ""), (None, 3, "x"), (2, None, "y"), (1, 9, "z"), (1, 9, "z"), (3, 0, "é" * 100_000)]
    b = [(1, 0, ""), (1, 5, None), (1, 9, "z"), (3, 0, "é" * 100_000)]
    assert audited(spark, a, b) == []
    assert audited(spark, a, []) == [(1, 0, "missing"), (1, 5, "missing"), (1, 9, "missing"), (3, 0, "missing")]
    assert audited(spark, [], []) == []
    two = [(1, 0, "p"), (1, 0, "q")]
    assert audited(spark, two, two) == [] or all(k == "corrupt" for _, _, k in audited(spark, two, two))
