import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftnet.llm import quality
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string"


def test_base_measures(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "a b", "#x $$\n#x $$\n \n \n#x $$", "é ü　ß x", "a " * 8, "a " * 9, "a b c d e f g h i " * 3]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + "\nline\n" * rng.randint(0, 4) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in quality.judged(df).select("doc_id", *quality.MEASURES, "base_failed").collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = [w.decode() for w in t.encode().split()]
        lines = [line for line in t.split("\n") if line.encode().split()]
        repeated = brute.repeated_words(words)
        failed = len(words) < 20 or 100 * repeated > 30 * len(words)
        assert got[i] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated, failed), (i, t)


def js_distance(p, q):
    mean = [(a + b) / 2 for a, b in zip(p, q)]
    half = lambda x: sum(a * math.log2(a / m) for a, m in zip(x, mean) if a)
    return math.sqrt((half(p) + half(q)) / 2)


def test_distances(spark):
    rng = random.Random(7)
    common = [f"w{'abcdefgh'[i]}" for i in range(8)]
    texts = [" ".join(rng.choices(common, range(8, 0, -1), k=120)) + "." for _ in range(30)] + ["Other Words 12 % " * 40]
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in quality.judged(df, common=5, most_repeated=100).collect()}
    terms = [[w.strip(".").lower() for w in t.split() if w[0].isalpha()] for t in texts]
    total = Counter(w for t in terms for w in t)
    top = sorted(total, key=lambda w: (-total[w], w))[:5]
    kind = lambda c: next(i for i, test in enumerate((c.islower(), c == " ", c.isupper(), c.isdigit(), c == ".", c == "%")) if test)
    classes = [Counter(map(kind, t)) for t in texts]
    all_classes = sum(classes, Counter())
    for i, t in enumerate(terms):
        n, everything = Counter(t), sum(total.values())
        p, q = [n[w] / len(t) for w in top], [total[w] / everything for w in top]
        assert got[i].word_distance == pytest.approx(js_distance([*p, 1 - sum(p)], [*q, 1 - sum(q)]), abs=1e-6)
        p, q = ([c[k] / c.total() for k in range(6)] for c in (classes[i], all_classes))
        assert got[i].class_distance == pytest.approx(js_distance(p, q), abs=1e-6)


def test_verdicts_and_guards(spark):
    rng = random.Random(1)
    prose = lambda k: " ".join(rng.choices(["the", "of", "and", "house", "tree", "river"], k=k))
    rows = [(i, prose(100), "en") for i in range(60)]
    rows += [(100, " ".join(f"{rng.randint(0, 999)}%" for _ in range(80)), "en"), (101, " ".join(f"q{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)), "en")]
    rows += [(102, " ".join("zyxwvutsrq"[i % 10] + "abc"[i % 3] for i in range(30)), "en"), (103, "%% ## " * 15 + prose(8), "xx"), (104, None, None), (None, prose(50), None)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, SCHEMA), least_reference=500, most_repeated=100).collect()}
    assert all(got[i].kept for i in range(60))
    assert not got[100].kept and got[100].class_distance > 0.5  # numbers and symbols
    assert not got[101].kept and got[101].word_distance > 0.9 and got[101].class_distance < 0.3  # no word of the language
    assert got[102].kept and got[102].word_distance is None  # too short for its words to tell
    assert got[103].kept and got[103].class_distance is None  # a language too small to be a reference
    assert got[104].base_failed and not got[104].kept
    assert got[None].kept


def test_plan_is_native_and_columns_clash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("Kept", F.lit(1)).withColumn("_terms", F.lit("x"))
    judged = quality.judged(docs)
    assert judged.columns == [*(c for c in docs.columns if c not in ("Kept", "_terms")), *quality.ADDED]
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Scan ExistingRDD"))
    assert quality.judged(spark.createDataFrame([], SCHEMA)).count() == 0
