import random

from siftnet.llm import neardup
from siftnet.llm.components import components
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def result(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, **kw).collect()}


def expected(rows, k):
    root = brute.components(rows, k)
    return {i: (len(brute.shingles(t, k)), root[i], root[i] == i) for i, t in rows}


def test_components(spark):
    rng = random.Random(1)
    edges = [(a, a + 1) for a in range(100, 160)] + [(7, b) for b in range(200, 260)] + [(rng.randrange(20), rng.randrange(300, 320)) for _ in range(25)]
    edges += [(5, 5), (260, 259)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_equals_brute_force_on_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in (4, 5):
        assert result(docs, shingle=k) == expected(rows, k)


def chain(n, words, step):
    """Texts of which neighbours are similar and distant ones are not."""
    text = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        out.append((1000 - i, " ".join(text)))
        for j in range(step):
            text[(i * step + j) % words] = f"x{i}_{j}"
    return out


def test_links_that_no_hub_sees_are_kept(spark):
    rows = chain(25, 400, 12) + [(i, f"only {i} words here that nobody else has {i}") for i in range(30)]
    rng = random.Random(4)
    rng.shuffle(rows)
    assert result(spark.createDataFrame(rows, SCHEMA), shingle=4) == expected(rows, 4)


def test_hub_rounds_and_cross_step_agree(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = f"n{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows, 4)
    assert result(df, shingle=4) == want
    monkeypatch.setattr(neardup, "FAMILY_SHINGLES", 0)
    assert result(df, shingle=4) == want
    monkeypatch.setattr(neardup, "CROSS_FACTOR", -10**9)
    assert result(df, shingle=4) == want


def test_edge_cases(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "É a b c"), (8, "é a b c"), (9, "a b c d"), (10, "A  B\nc d"),
        (11, long), (12, long + " end"),
    ]
    got = result(spark.createDataFrame([*rows, (9, "a b c d")], SCHEMA), shingle=4)
    assert got == expected(rows, 4)
    # null ids link with nothing and stay
    extra = spark.createDataFrame([(None, "a b c d", 1), (9, "a b c d", 2)], "doc_id long, text string, kept int")
    out = sorted((tuple(r) for r in neardup.near_duplicates(extra, shingle=4).collect()), key=repr)
    assert out == [(9, 1, 9, True), (None, 1, None, True)]
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_versions_of_one_document_are_one(spark):
    rows = [(5, "a b c d e"), (5, "p q r s t"), (6, "a b c d e"), (7, "p q r s t")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=4).select("doc_id", "component_id").collect()
    assert {tuple(r) for r in got} == {(5, 5), (6, 5), (7, 5)}


def test_families_too_large_for_a_task(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(neardup, "FAMILY_SHINGLES", 300)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(docs, shingle=4) == expected([(r.doc_id, r.text) for r in docs.collect()], 4)
    rows = chain(12, 200, 6)
    monkeypatch.setattr(neardup, "FAMILY_SHINGLES", 0)
    assert result(spark.createDataFrame(rows, SCHEMA), shingle=4) == expected(rows, 4)
