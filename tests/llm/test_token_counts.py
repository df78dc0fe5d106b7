import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftnet.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNT = token_counts.WordCounter(token_counts.encoder(PATH))


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", "<|startoftext|>x", "don't", "'s", "́", "e", " ", "\x1c", " ", "ΑΣ", "İ", "1990"])), max_size=8), st.sampled_from([" ", "\n", "\t ", "\x0b", "", "\r\n"]))
def test_sum_over_words_is_the_librarys_count(parts, joint):
    text = joint.join(parts)
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert COUNT([text.encode()]) == [library(text)]


def test_equals_the_library_on_whole_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = token_counts.count_tokens(docs, PATH, str(tmp_path), by_words=True)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()}
    for r in docs.collect():
        n = library(r.text)
        assert got[r.doc_id] == (len(r.text.encode()), n, n > 2048)


def test_only_distinct_misses_are_encoded(spark, tmp_path, monkeypatch):
    cache, schema = str(tmp_path), "doc_id long, text string"

    def stored():
        return sum(1 for _ in spark.read.parquet(cache + "/version=" + token_counts.tokenizer_version(PATH, True)).collect())

    one = spark.createDataFrame([(1, "a b"), (2, " a \n b "), (3, "c"), (3, "c")], schema)
    assert sorted(r.n_tokens for r in token_counts.count_tokens(one, PATH, cache, by_words=True).collect()) == [1, 1, 2, 2]
    assert stored() == 2
    two = spark.createDataFrame([(1, "a  b"), (4, "d e f")], schema)
    assert sorted(r.n_tokens for r in token_counts.count_tokens(two, PATH, cache, by_words=True).collect()) == [2, 3]
    assert stored() == 3
    # a stored count is taken as it is: nothing is encoded again
    before = stored()
    token_counts.count_tokens(two, PATH, cache, by_words=True).collect()
    assert stored() == before


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_encode_whole_texts(spark, tmp_path, name):
    path = public_tokenizers.path(name)
    rows = [(1, "Hello  world"), (2, "Hello world"), (3, None), (4, "")]
    out = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, str(tmp_path)).collect()
    encode = token_counts.encoder(path)
    assert {r.doc_id: r.n_tokens for r in out} == {i: encode([t or ""])[0] for i, t in rows}


def test_edge_cases(spark, tmp_path):
    rows = [(1, None, 1), (2, "", 2), (None, "x", 3), (4, "word " * 100_000, 4), (4, "word " * 100_000, 4), (5, " \n ", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, PATH, str(tmp_path), by_words=True).collect()), key=repr)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 1, 1, False), (4, 500_000, 100_000, True), (4, 500_000, 100_000, True), (5, 3, 0, False)], key=repr)
    assert token_counts.count_tokens(df.limit(0), PATH, str(tmp_path), by_words=True).count() == 0
