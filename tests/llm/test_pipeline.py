import corpus_pipeline
from siftnet.llm import packing
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=repr)


def test_each_stage_against_brute_force(spark):
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]

    clean = stages["toxicity"](spark, docs, at).cache()
    assert clean.columns == COLUMNS
    toxic = {r.doc_id for r in spark.read.parquet(f"{at}/labels.parquet").where("toxic = 1").collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert not {r.doc_id for r in docs.collect()} - kept - toxic or len({r.doc_id for r in docs.collect()} - kept - toxic) < 20

    near = stages["near_dedup"](spark, clean, at).cache()
    root = brute.components(rows_of(clean), 5)
    assert near.columns == COLUMNS
    assert rows_of(near) == [r for r in rows_of(clean) if root[r[0]] == r[0]]

    cut = stages["substring_dedup"](spark, near, at).cache()
    assert cut.columns == COLUMNS
    original = dict(rows_of(near))
    want = [(i, original[i] if not gone else kept) for i, n, gone, _, kept in brute.repeats(rows_of(near)) if gone < n or not n]
    assert rows_of(cut) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    safe = stages["decontamination"](spark, cut, at).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    assert safe.columns == COLUMNS
    assert rows_of(safe) == [r for r in rows_of(cut) if not brute.leaked([r], items)]

    packed = stages["packing"](spark, safe, at).collect()
    words = {i: len(t.encode().split()) for i, t in rows_of(safe)}
    held = {}
    for r in packed:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.n_words
    assert held == words
    bins = {}
    for r in packed:
        bins[r.shard, r.bin] = bins.get((r.shard, r.bin), 0) + r.n_words
    assert max(bins.values()) <= packing.CAPACITY


def test_stages_take_odd_rows(spark):
    at = "/root/testdata/sf0.001"
    rows = [(1, None, "en", None, None, 1.5), (2, "", None, "s", 0, 2.5), (None, "some words here", "en", "s", 3, 3.5), (4, "a b c d e f g", "en", "s", 13, 0.0)]
    rows += [(4, "a b c d e f g", "en", "s", 13, 0.0), (5, "A b c d e f g", "en", "s", 13, 0.1), (6, "w " * 30_000, "en", "s", 60_000, 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        assert stage(spark, docs.limit(0), at).count() == 0
        if name != "packing":
            assert out.columns == docs.columns
            got = sorted((r.doc_id for r in out.collect()), key=repr)
            assert got == {"near_dedup": [1, 2, 4, 6, None]}.get(name, [1, 2, 4, 4, 5, 6, None])


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "n_words", "shard", "bin"] and out.count() > 100
