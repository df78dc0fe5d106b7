import random

import numpy as np

from siftnet.llm import decontaminate
from tests.llm import brute

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        most = rng.randint(0, 6)
        assert decontaminate.edit_distance(a, b, most) == min(brute.edit_distance(a, b), most + 1)


def found(spark, rows, items, **kw):
    out = decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS), **kw).collect()
    return {(r.doc_id, r.item_id) for r in out}, out


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(999)}"
        elif kind == 1:
            words.insert(at, f"more{rng.randrange(999)}")
        else:
            words.pop(at)
    return words


def test_equals_brute_force_with_edits(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)))) for i in range(25)]
    rows = []
    for i in range(250):
        text = rng.choices(vocabulary, k=rng.randint(0, 80))
        if i % 2:
            phrase = items[rng.randrange(25)][1].split()
            text += edited(rng, phrase, rng.randint(0, len(phrase) // 5 + 2)) + rng.choices(vocabulary, k=rng.randint(0, 30))
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(text).title()))
    want = brute.leaked(rows, items)
    got, out = found(spark, rows, items)
    assert got <= want
    assert len(want) > 60 and len(got) >= 0.98 * len(want)
    # in blocks of items the result is the same up to the chance of the hashes
    assert len(found(spark, rows, items, block_items=7)[0] & want) >= 0.98 * len(want)
    for r in out[:50]:
        words, phrase = brute.bench_words(dict(rows)[r.doc_id]), brute.bench_words(dict(items)[r.item_id])
        assert brute.edit_distance(words[r.first_word : r.first_word + len(phrase)], phrase) == r.n_edits


def test_whole_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    # whole passages, by plain search
    plain = {(i, n) for i, t in docs for n, p in items if b" ".join(brute.bench_words(p)) in b" ".join(brute.bench_words(t))}
    got, _ = found(spark, docs, items)
    assert plain and plain <= got


def test_edge_cases(spark):
    phrase = "one two three four five six seven"
    rows = [(1, None), (2, ""), (None, phrase), (3, "x " * 50_000 + phrase + " y" * 50_000), (4, phrase.upper()), (4, phrase.upper()), (5, "one two three four")]
    items = [(1, phrase), (2, phrase), (3, None), (4, ""), (5, "a b"), (None, phrase)]
    got, out = found(spark, rows, items)
    assert got == {(None, 1), (None, 2), (3, 1), (3, 2), (4, 1), (4, 2)}
    assert len([r for r in out if r.doc_id == 4]) == 4
    assert found(spark, [], items)[0] == set() and found(spark, rows, [])[0] == set()
    kept = decontaminate.without_leaks(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", n_edits int"), spark.createDataFrame(items, ITEMS))
    assert sorted((r.doc_id, r.n_edits) for r in kept.collect()) == [(1, 1), (2, 1), (5, 1)]


def test_edit_distance_with_a_free_end():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        most = rng.randint(0, 6)
        want = min(brute.edit_distance(a, b[:n]) for n in range(len(b) + 1))
        assert decontaminate.edit_distance(a, b, most, free_end=True) == min(want, most + 1)


def test_insertions_and_deletions_are_paid_once(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(16, 59)))) for i in range(20)]
    rows = []
    for i in range(120):
        m = items[i % 20][1].split()
        k = len(m) // 5
        n = rng.randint(k // 2 + 1, k + i % 2)
        for _ in range(n):
            at = rng.randrange(1, len(m) - 1)
            m[at : at + i // 2 % 2] = [] if i // 2 % 2 else [f"more{rng.randrange(999)}"]
        rows.append((i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)) + m + rng.choices(vocabulary, k=rng.randint(0, 30)))))
    rows.append((120, " ".join(vocabulary)))
    want = brute.leaked_at_any_length(rows, items)
    got, out = found(spark, rows, items, free_end=True)
    assert got <= want
    assert len(want) > 60 and len(got) >= 0.98 * len(want) and len(brute.leaked(rows, items)) < 0.8 * len(want)
    for r in out:
        words, phrase = brute.bench_words(dict(rows)[r.doc_id])[r.first_word :], brute.bench_words(dict(items)[r.item_id])
        k = len(phrase) // 5
        assert min(brute.edit_distance(words[:n], phrase) for n in range(len(phrase) - k, len(phrase) + k + 1)) == r.n_edits
    docs = spark.createDataFrame(rows, DOCS)
    kept = decontaminate.without_leaks(docs, spark.createDataFrame(items, ITEMS), free_end=True)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in got}


def test_the_query_and_the_pipeline_find_scattered_insertions(spark, tmp_path):
    import corpus_pipeline
    from siftnet.llm import queries

    item = [f"w{i}" for i in range(40)]
    text = " ".join(["a b c"] + item[:12] + ["x0"] + item[12:16] + ["x1"] + item[16:20] + ["x2"] + item[20:24] + ["x3"] + item[24:28] + ["x4"] + item[28:] + ["d e f"])
    cut = " ".join(["a b c"] + item[:12] + item[13:16] + item[17:20] + item[21:24] + item[25:28] + item[29:] + ["d e f g h i j k l"])
    docs = spark.createDataFrame([(1, text), (2, cut), (3, "clean")], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(item))], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in queries.op8_benchmark_leaks(spark, str(tmp_path)).select("doc_id", "item_id", "n_edits").collect()}
    assert got == {(1, 7, 5), (2, 7, 5)}
    assert [r.doc_id for r in corpus_pipeline.remove_leaks(spark, docs, str(tmp_path)).collect()] == [3]


def test_distances_of_many_pairs():
    rng = random.Random(4)
    for _ in range(200):
        m, n = rng.randint(1, 14), rng.randint(1, 20)
        most, values = rng.randint(0, min(6, m)), np.array([rng.randrange(3) for _ in range(40)], np.uint64)
        items = np.array([[rng.randrange(3) for _ in range(m)] for _ in range(n)], np.uint64)
        starts = np.array([rng.randrange(40) for _ in range(n)])
        ends = np.array([rng.randint(s, 40) for s in starts])
        for free_end in (False, True):
            until = np.minimum(ends, starts + m + most * free_end)
            want = [decontaminate.edit_distance(i.tolist(), values[a:b].tolist(), most, free_end) for i, a, b in zip(items, starts, until)]
            assert decontaminate.distances(items, values, starts, ends, most, free_end).tolist() == want


def test_recall_of_long_items_beside_short_ones(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(20_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(16, 30)))) for i in range(200)]
    items += [(1000 + i, " ".join(rng.choices(vocabulary, k=400))) for i in range(10)]
    rows = []
    for i in range(200):
        m = items[200 + i % 10][1].split()
        # the largest distance, one edit in each run of five words, all net insertions or deletions, or none
        for at in range(len(m) - 5, -1, -5):
            m[at + 1 : at + 2] = [["x"], [m[at + 1], "x"], [], ["x"]][i % 3 if i % 4 else 0]
        rows.append((i, " ".join(rng.choices(vocabulary, k=20) + m + rng.choices(vocabulary, k=20))))
    got, _ = found(spark, rows, items, free_end=True)
    assert {(i, 1000 + i % 10) for i in range(200)} >= got and len(got) >= 0.99 * 200


def test_sizes_beyond_the_most_repetitions_are_verified_without_lsh(spark, monkeypatch):
    rng = random.Random(10)
    items = [(i, " ".join(rng.choices([f"v{j}" for j in range(60)], k=size))) for i, size in enumerate([5, 9, 20, 20, 33, 48, 60])]
    rows = [(i, " ".join(edited(rng, items[i % 7][1].split(), rng.randint(0, 13)) + ["end"] * (i % 5))) for i in range(150)]
    monkeypatch.setattr(decontaminate, "LEVELS", ())
    want = brute.leaked_at_any_length(rows, items)
    assert len(want) > 30 and found(spark, rows, items, free_end=True)[0] == want
    assert found(spark, rows, items)[0] == brute.leaked(rows, items)
