import itertools

import numpy as np

from siftnet.llm import langid


def best_path(scores, switch):
    best = None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        value = sum(scores[i, k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))
        if best is None or value > best + 1e-9:
            best = value
    return best


def value_of(path, scores, switch):
    return sum(scores[i, k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_is_optimal_for_every_block_size():
    rng = np.random.default_rng(5)
    for block in (1, 2, 3, 64):
        for _ in range(30):
            lengths = rng.integers(0, 8, size=5)
            firsts = np.concatenate([[0], np.cumsum(lengths)])
            scores = rng.normal(size=(int(lengths.sum()), 3)) * 2
            path = langid.viterbi(scores, firsts, switch=1.5, block=block)
            for a, b in zip(firsts[:-1], firsts[1:]):
                if b > a:
                    assert abs(value_of(path[a:b], scores[a:b], 1.5) - best_path(scores[a:b], 1.5)) < 1e-6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = langid.identify(docs)
    rows = out.where("held_out").select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 < r.score <= 1 for r in rows)


def test_mixed_text_gets_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    picked = {r.lang: " ".join(r.text.split()[:60]) for r in docs.where("length(text) > 600").orderBy("doc_id").collect()}
    mixed = spark.createDataFrame([(1, picked["de"] + ". " + picked["fr"])], "doc_id long, text string")
    spans = langid.predict(mixed, model).first().spans
    assert [s.lang for s in spans] == ["de", "fr"] and abs(spans[1].first_word - spans[0].n_words) == 0


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, "это русский текст про город", "ru") for i in range(40)] + [(i + 100, "this is english text about towns", "en") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    latin, cyrillic = langid.SCRIPT_NAMES.index("latin"), langid.SCRIPT_NAMES.index("cyrillic")
    assert model.langs == ("en", "ru")
    assert model.allowed[latin].tolist() == [True, False] and model.allowed[cyrillic].tolist() == [False, True]
    got = langid.predict(spark.createDataFrame([(1, "xxqz")], "doc_id long, text string"), model).first()
    assert got.lang_pred == "en"


def test_edge_cases(spark):
    rows = [(i, "das ist der text und die stadt", "de") for i in range(30)] + [(i + 50, "this is the text and the town", "en") for i in range(30)]
    rows += [(200, None, "de"), (201, "", "de"), (202, "12 -- 34 !", "en"), (None, "the town", None), (204, "die stadt " * 30_000, None), (204, "x", None), (205, "\U0001d400퟿日本", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS `spans`")
    got = [(r.doc_id, r.lang_pred, r.score, r.held_out) for r in langid.identify(df).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g for g in got}
    for i in (200, 201, 202):
        assert by[i][1:3] == ("und", 0.0)
    assert by[None][1] == "en" and by[None][3] is False
    assert ("de", 1.0) in [g[1:3] for g in got if g[0] == 204]
    nothing = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[4:6] for r in langid.identify(nothing).collect()] == [("und", 0.0)]
    assert langid.identify(nothing.limit(0)).count() == 0
