"""Language identification of mixed-language texts.

Each word is a run of letters. The script of its first letter (by ranges of code points) narrows the languages it may be in, to
those whose training words use that script. Within them, a word scores the log-likelihood of its character trigrams. Viterbi
then labels the words of a text: staying in a language is free, every switch costs ``SWITCH``. Runs of one label are the spans; the
text's language is the one with most letters, its score that language's share of the letters.

The model is fitted on a bounded sample: at most ``SAMPLE_ROWS`` documents with a language, chosen by hash of doc_id, without those
whose crc32(doc_id) mod 4 is 2. Trigrams are counted in ``BUCKETS`` hash buckets, so the model's size is fixed per language.

The Viterbi scan is exact and vectorised: texts are cut into blocks, each block is summed up as a matrix of best scores from
any language before it to any language at its end, the matrices are chained, and the blocks are then labelled side by side.

Rows and edge cases: texts that are null or without letters are `und` with score 0, as is every text if nothing can be learned;
rows with a null doc_id are predicted and count as not held out; input columns named like the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftnet.llm.words import mix, per_chunk, without

SAMPLE_ROWS, BUCKETS = 8_000, 1 << 16
#: Cost of a switch in nats; pseudo-count of a bucket; least share of a language's words in a script that it counts as using.
SWITCH, SMOOTH, SCRIPT_SHARE = 12.0, 0.5, 0.005
#: Words per block, and the score of a language that a word cannot be in.
BLOCK, IMPOSSIBLE = 64, -1e4
ADDED = ("held_out", "lang_pred", "score", "spans")

# First and last code points of scripts, from the Unicode block names.
SCRIPTS = [
    (0x0000, 0x024F, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x4DBF, "han"),
    (0x4E00, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for _, _, name in SCRIPTS)]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 or, for a letter, its script's number + 1; and the lower-case form. Built once per worker."""
    kind = np.zeros(0x110000, np.uint8)
    kind[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = 1
    for first, last, name in SCRIPTS:
        part = kind[first : last + 1]
        part[part > 0] = SCRIPT_NAMES.index(name) + 1
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        if kind[c] and len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
    return kind, lower


@dataclass(frozen=True)
class Features:
    """Of a run of texts: the trigram bucket of every letter, and per word its first letter, letters, script and text."""

    buckets: np.ndarray
    first_letter: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    owner: np.ndarray


def features(data: np.ndarray, bounds: np.ndarray) -> Features:
    kind, lower = _tables()
    texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]
    # a code point that is no letter stands after each text, so words end with their text
    points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = kind[points]
    at = np.flatnonzero(kinds)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Features(none, none, none, none, none)
    low = lower[points].astype(np.uint64)
    low[kinds == 0] = 1
    before = np.where(at > 0, low[at - 1], np.uint64(1))
    code = (before << np.uint64(42)) | (low[at] << np.uint64(21)) | low[at + 1]
    buckets = (mix(code) & np.uint64(BUCKETS - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return Features(buckets, first, np.diff(np.append(first, len(at))), kinds[at[first]].astype(np.int64) - 1, np.searchsorted(ends, at[first], "right"))


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    weights: np.ndarray  # bucket x language
    allowed: np.ndarray  # script x language

    def word_scores(self, f: Features) -> np.ndarray:
        scores = np.add.reduceat(self.weights[f.buckets], f.first_letter, axis=0).astype(np.float64)
        return np.where(self.allowed[f.script], scores, IMPOSSIBLE)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Model | None:
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang")
    picked = known.orderBy(F.xxhash64("doc_id", F.lit("language")), "doc_id", "lang").limit(SAMPLE_ROWS).distinct()
    langs = tuple(sorted(r["lang"] for r in picked.select("lang").distinct().collect()))
    if not langs:
        return None
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])

    def count(batch, data, bounds):
        f = features(data, bounds)
        lang = np.array([langs.index(v) for v in batch.column("lang").to_pylist()])
        of_word = lang[f.owner] if len(f.owner) else f.owner
        # scripts are counted in the buckets after those of the trigrams
        keys = np.concatenate([np.repeat(of_word, f.letters) * 2 * BUCKETS + f.buckets, of_word * 2 * BUCKETS + BUCKETS + f.script])
        key, n = np.unique(keys, return_counts=True)
        return pa.record_batch({"key": key.astype(np.int64), "n": n.astype(np.int64)})

    rows = per_chunk(sample, "key long, n long", count).groupBy("key").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(langs) * 2 * BUCKETS)
    counts[[r["key"] for r in rows]] = [r["n"] for r in rows]
    counts = counts.reshape(len(langs), 2 * BUCKETS).T
    grams, scripts = counts[:BUCKETS], counts[BUCKETS : BUCKETS + len(SCRIPT_NAMES)]
    weights = np.log((grams + SMOOTH) / (grams.sum(axis=0) + SMOOTH * BUCKETS))
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    return Model(langs, weights.astype(np.float32), allowed)


def viterbi(scores: np.ndarray, firsts: np.ndarray, switch: float = SWITCH, block: int = BLOCK) -> np.ndarray:
    """Best label of every word; scores is word x language, firsts the number of each text's first word (one more than texts)."""
    n, langs = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    blocks = -(-np.diff(firsts) // block)
    texts = np.flatnonzero(blocks)
    texts = texts[np.argsort(-blocks[texts], kind="stable")]
    first_block = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    of = np.repeat(np.arange(len(blocks)), blocks)
    start = firsts[:-1][of] + (np.arange(total) - first_block[of]) * block
    at = start[:, None] + np.arange(block)
    inside = at < firsts[1:][of][:, None]
    x = np.where(inside[:, :, None], scores[np.minimum(at, n - 1)], 0.0)

    # best score from any language before a block to any at its end
    best = np.full((total, langs, langs), -1e18)
    best[:, range(langs), range(langs)] = 0
    for t in range(block):
        best = np.maximum(best, best.max(axis=2, keepdims=True) - switch) + x[:, t, None, :]

    # chain the blocks of each text; texts are ordered by length, so those still running are a prefix
    running = [texts[: int(np.searchsorted(-blocks[texts], -step, "left"))] for step in range(int(blocks.max()))]
    value = np.zeros((len(blocks), langs))
    entry = np.zeros((total, langs))
    for step, live in enumerate(running):
        b = first_block[live] + step
        entry[b] = value[live]
        value[live] = (value[live][:, :, None] + best[b]).max(axis=1)
    label = value.argmax(axis=1)
    came, left = np.zeros(total, np.int64), np.zeros(total, np.int64)
    for step in range(len(running) - 1, -1, -1):
        live = running[step]
        b = first_block[live] + step
        left[b] = label[live]
        came[b] = label[live] = (entry[b] + best[b, :, label[live]]).argmax(axis=1)

    # inside the blocks, from the language before to the language at the end
    rows = np.arange(total)
    value = np.full((total, langs), -1e18)
    value[rows, came] = 0
    stay, source = np.empty((block, total, langs), bool), np.empty((block, total), np.int64)
    for t in range(block):
        source[t] = value.argmax(axis=1)
        jump = value.max(axis=1, keepdims=True) - switch
        stay[t] = value >= jump
        value = np.maximum(value, jump) + x[:, t]
    path, label = np.empty((total, block), np.int64), left
    for t in range(block - 1, -1, -1):
        path[:, t] = label
        label = np.where(stay[t, rows, label], label, source[t])
    return path[inside]


_SPAN = pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with held_out, lang_pred, score and spans (language, first word, words; words are runs of letters)."""
    docs = without(docs, *ADDED).withColumn("held_out", held_out())
    spans = T.ArrayType(
        T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
    )
    if model is None:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(spans).alias("spans"))
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", spans)]
    )

    def label(batch, data, bounds):
        f = features(data, bounds)
        n, langs = batch.num_rows, model.langs
        firsts = np.searchsorted(f.owner, np.arange(n + 1))
        labels = viterbi(model.word_scores(f), firsts) if len(f.owner) else f.owner
        letters = np.bincount(f.owner * len(langs) + labels, f.letters, n * len(langs)).reshape(n, -1)
        total, best = letters.sum(axis=1), letters.argmax(axis=1)
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(labels) != 0) | (np.diff(f.owner) != 0)])) if len(labels) else labels
        ends = np.append(starts[1:], len(labels))
        found: list[list] = [[] for _ in range(n)]
        for a, b in zip(starts.tolist(), ends.tolist()):
            i = int(f.owner[a])
            found[i].append({"lang": langs[labels[a]], "first_word": a - int(firsts[i]), "n_words": b - a})
        columns = {name: batch.column(name) for name in batch.schema.names}
        return pa.record_batch(
            columns
            | {
                "lang_pred": [langs[k] if t else "und" for k, t in zip(best, total)],
                "score": pa.array(letters.max(axis=1) / np.maximum(total, 1), pa.float64()),
                "spans": pa.array(found, pa.list_(_SPAN)),
            }
        )

    return per_chunk(docs, schema, label)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows of ``docs`` with a language that are not held out, and predict all. The language is never an input."""
    return predict(docs, fit(docs))
