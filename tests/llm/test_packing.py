import random

from siftnet.llm import packing


def plain(items, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for length, source, cluster in items:
        fits = [(b["room"], n) for n, b in enumerate(bins) if b["room"] >= length and source not in b["s"] and cluster not in b["c"]]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        bins[n]["room"] -= length
        bins[n]["s"] |= {source} - {None}
        bins[n]["c"] |= {cluster} - {None}
        out.append(n)
    return out


def test_best_fit_equals_the_plain_search():
    for seed in range(60):
        rng = random.Random(seed)
        items = [(rng.randint(0, 40), rng.choice([None, "a", "a", "b", "c"]), rng.choice([None, 1, 2, 3])) for _ in range(rng.randint(0, 80))]
        items.sort(key=lambda x: -x[0])
        bit = lambda v, names: 0 if v is None else 1 << names.index(v)
        got = packing.best_fit([x[0] for x in items], [bit(x[1], ["a", "b", "c"]) for x in items], [bit(x[2], [1, 2, 3]) for x in items], 40)
        assert got == plain(items, 40)


def check(items, packed, capacity):
    assert len(items) == len(packed)
    held = {}
    source = {(r.doc_id, r.piece): (r.source, r.cluster, r.n_words) for r in items}
    for r in packed:
        held.setdefault((r.shard, r.bin), []).append(source[r.doc_id, r.piece])
    for rows in held.values():
        assert sum(r[2] for r in rows) <= capacity
        for k in (0, 1):
            known = [r[k] for r in rows if r[k] is not None]
            assert len(known) == len(set(known))


def test_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = packing.items_of(docs)
    rows = items.collect()
    assert {r.doc_id: r.n for r in items.groupBy("doc_id").agg({"n_words": "sum"}).withColumnRenamed("sum(n_words)", "n").collect()} == {
        r.doc_id: len(r.text.encode().split()) for r in docs.collect()
    }
    for shard_items in (50, 4096):
        check(rows, packing.pack(items, shard_items=shard_items).collect(), packing.CAPACITY)


def test_edge_cases(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "w " * 5000, "s"), (4, "w " * 2048, None), (None, "a b", None), (6, "A  b", "t"), (6, "A  b", "t"), (7, "a b", "u")]
    items = packing.items_of(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, cluster int"))
    got = sorted(((r.doc_id, r.piece, r.n_words) for r in items.collect()), key=repr)
    assert got == sorted([(1, 0, 0), (2, 0, 0), (3, 0, 2048), (3, 1, 2048), (3, 2, 904), (4, 0, 2048), (None, 0, 2), (6, 0, 2), (6, 0, 2), (7, 0, 2)], key=repr)
    packed = packing.pack(items).collect()
    assert len(packed) == 10
    copies = [(r.shard, r.bin) for r in packed if r.doc_id in (None, 6, 7)]
    assert len(set(copies)) == 4
    assert packing.pack(items.limit(0)).count() == 0
