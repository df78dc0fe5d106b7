import numpy as np

from siftnet.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, k=20, every=20):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        scores = (x * x[q]).sum(axis=1)
        order = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != ids[q])[:k]
        out[int(ids[q])] = [(i, -s) for s, i in order]
    return out


def found(df, **kw):
    out = {}
    for r in ann.nearest(df, "vec_id % 20 = 0", **kw).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_recall_and_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want, got = brute(ids, x), found(df)
    assert got.keys() == want.keys()
    exact = {q: dict(zip(ids.tolist(), (x * x[ids.tolist().index(q)]).sum(axis=1).tolist())) for q in want}
    hits = 0
    for q, rows_ in got.items():
        assert [r[0] for r in rows_] == list(range(1, 21))
        assert [(r[1], r[2]) for r in rows_] == sorted(((r[1], r[2]) for r in rows_), key=lambda p: (-p[1], p[0]))
        assert all(abs(exact[q][i] - s) < 1e-12 and i != q for _, i, s in rows_)
        hits += len({i for _, i, _ in rows_} & {i for i, _ in want[q]})
    assert hits >= 0.92 * sum(len(v) for v in want.values())


def test_walk_visits_cells_in_order_of_the_sum():
    rng = np.random.default_rng(1)
    index = ann.Index(rng.normal(size=(6, 3)), rng.normal(size=(5, 3)), 1.0, rng.integers(0, 3, size=30))
    q = rng.normal(size=6)
    cells = index.walk(q)
    near = [(index.left @ q[:3])[c // 5] + (index.right @ q[3:])[c % 5] for c in cells]
    assert near == sorted(near, reverse=True) and sorted(cells) == np.flatnonzero(index.counts).tolist()


def test_hot_vector_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[100:250] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    want = brute(np.arange(300), x.astype(np.float64))
    for q in (100, 120, 140):
        assert [i for _, i, _ in got[q]] == [i for i, _ in want[q]]


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(0, None), (20, []), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [nan, 1.0]), (100, [inf, 1.0]), (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0])]
    good = [(140, [1.0, 0.0]), (141, [1.0, 0.0]), (141, [1.0, 0.0]), (142, [0.0, 1.0]), (143, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 3) for i, v in bad + good], SCHEMA + ", rank int")
    assert found(df) == {140: [(1, 141, 1.0), (2, 142, 0.0), (3, 143, -1.0)]}
    assert found(df.limit(0)) == {} and found(df.where("vec_id = 140")) == {}
    assert found(df, neighbours=1) == {140: [(1, 141, 1.0)]}
