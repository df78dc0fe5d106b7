import random

import numpy as np

from siftnet.llm import divergence
from tests.llm import brute

SCHEMA = "text string, lang string, source string"


def run(df, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


def test_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert run(docs) == brute.divergence(rows, 30)
    assert run(docs, min_docs=4, top=7) == brute.divergence(rows, 4, top=7)


def test_many_sources_and_slices(spark):
    """More sources than a tile, terms in many slices, sources without terms, ties."""
    rng = random.Random(2)
    rows = []
    for i in range(300):
        words = [rng.choice("abcdefghij") * rng.randint(1, 12) for _ in range(rng.randint(0, 30))]
        rows.append((" ".join(words), rng.choice(["x", "y"]), f"s{rng.randint(0, 16)}"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected = brute.divergence(rows, 3)
    assert run(df, min_docs=3, tile_sources=3, slice_terms=16) == expected
    assert run(df, min_docs=3, first_prefix=1) == expected
    assert run(df, min_docs=3, first_prefix=64) == expected


def test_refinement_discards_prefixes(spark):
    """A level's prefixes that begin too few documents' terms are gone at the next."""
    rows = [("abcdef abcdeg", "l", "s"), ("abcdeh abcxyz", "l", "s"), ("zzzzzz ab", "l", "s"), ("ab", "m", "s")]
    blocks = divergence.term_blocks(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    level = {(r.lang, bytes(r.prefix).decode(), r.whole): r.n_docs for r in divergence.extensions(blocks, 0, 3).collect()}
    assert level == {("l", "abc", False): 2, ("l", "zzz", False): 1, ("l", "ab", True): 1, ("m", "ab", True): 1}
    longer = {(bytes(r.parent).decode(), bytes(r.prefix).decode(), r.whole): r.n_docs for r in divergence.extensions(blocks, 3, 6).collect()}
    assert longer == {("abc", w, True): 1 for w in ("abcdef", "abcdeg", "abcdeh", "abcxyz")} | {("zzz", "zzzzzz", True): 1}
    assert divergence.kept_terms(blocks, 2, 3).collect() == []


def test_edge_cases(spark):
    long = "é" * 4000
    rows = [
        (None, None, None), ("", "", ""), (f"{long} Ab.AB;ab1ab", "l", None), (f"{long}x {long}", "l", "s"), (f"{long} ÀÉ àé", "l", "s"),
        ("only only", "m", "s"), ("only only", "m", "s"), (None, "m", "t"), ("12 34 !", "n", "a"), ("", "n", "b"), ("x", "n", "ä"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as term", "2 as prefix", "3 as n", "4 as block")
    for least in (1, 2, 3):
        assert run(df, min_docs=least) == brute.divergence(rows, least), least
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_packing_round_trip():
    for values in ([], [0], [255, 3], [256], [70_000, 1], [2**40]):
        assert divergence.unpacked(divergence.packed(np.array(values, np.int64))).tolist() == values
