import random

from pyspark.sql import functions as F

from siftnet.llm.substrings import lengths, remove_repeats
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def run(df, **kw):
    out = remove_repeats(df, **kw)
    return sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def test_levels_double():
    assert lengths(50) == [25, 50]
    assert lengths(200) == [25, 50, 100, 200]
    assert lengths(7) == [7]


def test_equals_brute_force_on_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs) == sorted((r[:4] for r in brute.repeats(rows)), key=repr)


def test_equals_brute_force_at_every_window(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdef") * rng.randint(1, 3) for _ in range(400)]
    rows = []
    for i in range(40):
        text = []
        while len(text) < rng.randint(0, 150):
            at = rng.randrange(350)
            text += base[at : at + rng.randint(1, 60)] + [f"w{rng.randrange(50)}"]
        rows.append((i, " \t".join(text)))
    for window, seed in ((3, 20), (8, 2), (24, 5), (41, 5)):
        expected = sorted((r[:4] for r in brute.repeats(rows, window)), key=repr)
        assert run(spark.createDataFrame(rows, SCHEMA), window=window, seed=seed) == expected, window


def test_edge_cases(spark):
    words = [f"w{i}" for i in range(60)]
    text = " ".join(words)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (5, text), (4, "x " + text), (4, "x " + text), (6, text), (None, text), (None, None),
        (7, text + " y"), (8, text), (8, "other"), (9, "é " * 49), (10, "é " * 50), (11, " ".join(words * 300)),
    ]
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert got == sorted((r[:4] for r in brute.repeats(rows)), key=repr)


def test_text_and_columns(spark):
    words = " ".join(f"w{i}" for i in range(55))
    rows = [(1, "a  " + words, "k", 5), (2, "b " + words + " c", "l", 6), (3, " kept  as it is ", "m", 7)]
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, _copies string, n_words int"))
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in out.collect()}
    assert got == {1: ("a  " + words, 56, 0), 2: ("b c", 57, 55), 3: (" kept  as it is ", 4, 0)}
    assert sorted(out.columns) == ["doc_id", "kept_sha256", "n_removed", "n_words", "text"]


def test_empty_table_and_other_id_type(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    words = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, words), (2, words)], SCHEMA).withColumn("doc_id", F.col("doc_id").cast("int"))
    assert [r[2] for r in run(df)] == [0, 50]
