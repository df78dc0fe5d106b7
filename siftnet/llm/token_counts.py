"""Token counts through a digest cache.

Each text is reduced to a digest of its normalised content. The digest and the tokenizer's version digest (its file, its library and
how it is called) are joined to the cache table; only distinct contents without a stored count are encoded, once each, and their
counts are appended to the cache. The counts are then joined back by digest. The cache is a Parquet table below ``cache``, one
folder per tokenizer version; a failed run leaves it as it was, and a repeated append of a digest does no harm, as digests are
read distinct.

For a tokenizer that drops white space and never joins across it (``by_words``), the normalised content has each run of
ASCII white space as one space, and within a task each distinct word is encoded once: a text's count is the sum over its words. The
memory for words is bounded. Other tokenizers encode whole texts, and the content is the text as it is.

Rows and edge cases: null texts count as empty and have 0 tokens; repeated rows give repeated results; input columns named like the
added ones are replaced.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from importlib.metadata import version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftnet.llm.words import per_chunk, without

ADDED = ("n_bytes", "n_tokens", "over_limit", "digest")
#: Words whose counts a task remembers at once.
MEMO_WORDS = 400_000


def tokenizer_version(path: str, by_words: bool) -> str:
    """Digest of all that a count depends on besides the text."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"{library} {version(library)} {content} {by_words}".encode()).hexdigest()[:32]


def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts of texts as the file's library gives them, without added special tokens."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(e) for e in model.encode(texts, num_threads=1)]


class WordCounter:
    """Counts per text as sums over words, each distinct word encoded once while it is remembered."""

    def __init__(self, encode: Callable[[list[str]], list[int]], most: int = MEMO_WORDS):
        self.encode, self.most, self.known = encode, most, {}

    def __call__(self, texts: list[bytes]) -> list[int]:
        if len(self.known) > self.most:
            self.known.clear()
        lists = [t.split() for t in texts]  # bytes are split at ASCII white space only
        new = list({w for words in lists for w in words} - self.known.keys())
        self.known.update(zip(new, self.encode([w.decode("utf-8", "replace") for w in new])))
        return [sum(map(self.known.__getitem__, words)) for words in lists]


_COUNTERS: dict[tuple[str, bool], Callable[[list[bytes]], list[int]]] = {}


def _counter(path: str, by_words: bool) -> Callable[[list[bytes]], list[int]]:
    """One per Python worker: the tokenizer is loaded once, and words stay known from task to task."""
    if (path, by_words) not in _COUNTERS:
        encode = encoder(path)
        _COUNTERS[path, by_words] = WordCounter(encode) if by_words else lambda texts: encode([t.decode("utf-8", "replace") for t in texts])
    return _COUNTERS[path, by_words]


def _encoded(contents: DataFrame, path: str, by_words: bool) -> DataFrame:
    def count(rows, data, bounds):
        texts = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.record_batch({"digest": rows.column("digest"), "n_tokens": pa.array(_counter(path, by_words)(texts), pa.int64())})

    return per_chunk(contents, "digest binary, n_tokens long", count)


def _cached(spark: SparkSession, folder: str) -> DataFrame:
    schema = "digest binary, n_tokens long"
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, by_words: bool = False, limit: int = 2048) -> DataFrame:
    """``docs`` with n_bytes, n_tokens, over_limit (more tokens than ``limit``) and the content digest."""
    spark = docs.sparkSession
    folder = f"{cache.rstrip('/')}/version={tokenizer_version(tokenizer, by_words)}"
    text = F.coalesce(F.col("text"), F.lit(""))
    content = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")) if by_words else text
    docs = without(docs, *ADDED)

    keyed = docs.select(content.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    # copies are summed up before the shuffle, so that a content with very many copies stays small
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(_cached(spark, folder), "digest", "left_anti")
    _encoded(misses, tokenizer, by_words).write.mode("append").parquet(folder)

    stored = _cached(spark, folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    slim = docs.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("digest", F.unhex(F.sha2(content, 256)))
    return slim.join(stored, "digest", "left").withColumn("over_limit", F.col("n_tokens") > limit)
