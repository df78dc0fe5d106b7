"""Substring deduplication by level-wise doubling.

Windows of ``window`` words that repeat across documents are found by lengths that double: window/2**j, ..., window/2,
window. Only windows whose shorter part repeats in another document at one length are extended to twice that length; a level
without survivors ends the search.

* Level 1 does not look at every window: of the short windows inside each window of level 2, a document keeps the one with the
  smallest hash. Equal long windows choose equal short ones, so no repeat of level 2's length is missed, and about one
  position in fourteen is shuffled.
* Later levels look at the windows that contain a surviving shorter one, and only at those.
* The last level decides by 96 bits of the window's hash.

Whole copies of an earlier text are recognised by the hash of their words and are not extended: what they hold,
their first copy holds. Texts cross the network once, by doc_id; all levels read that one shuffle.

Rows and edge cases: null or blank texts have no words; rows with a null doc_id are left as they are and remove nothing;
rows that share a doc_id are one document (a window counts as repeated only if a smaller doc_id has it); a document shorter
than the window is left as it is. Input columns named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftnet.llm.words import Words, long_ids, per_chunk, run_hashes, signed, split, window_hashes, without
from siftnet.session import checkpointed

ADDED = ("n_words", "n_removed", "kept_sha256")
#: Shortest length that a level begins with.
SEED_WORDS = 20


def lengths(window: int, seed: int = SEED_WORDS) -> list[int]:
    """The levels: window, half of it, half of that, down to the seed length."""
    found = [window]
    while found[0] > 1 and (found[0] + 1) // 2 >= seed:
        found.insert(0, (found[0] + 1) // 2)
    return found


def _values(words: Words) -> tuple[np.ndarray, np.ndarray]:
    return words.hashes(0), words.hashes(1)


def minima(values: np.ndarray, starts: np.ndarray, owner: np.ndarray, span: int) -> np.ndarray:
    """Of every ``span`` consecutive windows of one text, the place of the one with the smallest hash (the first if equal)."""
    if len(values) < span:
        return np.zeros(0, np.int64)
    # minima over runs that double in length, then two overlapping runs make the span
    at = np.arange(len(values))
    run = 1
    while run * 2 <= span:
        left, right = at[: len(at) - run], at[run:]
        at = np.where(values[right] < values[left], right, left)
        run *= 2
    rest = span - run
    left, right = at[: len(at) - rest], at[rest:]
    at = np.where(values[right] < values[left], right, left)
    whole = owner[starts[: len(at)]] == owner[starts[span - 1 :][: len(at)]]
    return np.unique(at[whole])


def _first_level(texts: DataFrame, length: int, following: int) -> DataFrame:
    """(h, doc_id): the chosen short windows of each document."""

    def chosen(rows, data, bounds):
        words = split(data, bounds)
        starts, h = window_hashes(words, words.hashes(0), length)
        owner = words.owner()
        at = minima(h, starts, owner, following - length + 1)
        pairs = np.unique(np.stack([owner[starts[at]], signed(h[at])]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
        return pa.record_batch({"h": pairs[1], "doc_id": ids[pairs[0]].astype(np.int64)})

    return per_chunk(texts, "h long, doc_id long", chosen)


def _covered(words: Words, values: np.ndarray, short: int, length: int, keep: list[np.ndarray], dense: bool) -> np.ndarray:
    """Starts of the ``length``-windows to look at: both ends are surviving short windows, or (sparse) any inside is one."""
    starts, h = window_hashes(words, values, short)
    alive = np.zeros(len(values), bool)
    owner = words.owner()
    if len(starts):
        of = owner[starts]
        edges = np.searchsorted(of, np.arange(len(keep) + 1))
        for i, kept in enumerate(keep):
            lo, hi = edges[i], edges[i + 1]
            if len(kept) and hi > lo:
                alive[starts[lo:hi]] = np.isin(h[lo:hi], kept)
    ends = np.repeat(words.firsts[1:], words.counts)
    at = np.arange(len(values))
    at = at[at + length <= ends]
    reach = length - short
    if dense:
        return at[alive[at] & alive[at + reach]]
    total = np.concatenate([[0], np.cumsum(alive)])
    return at[total[at + reach + 1] > total[at]]


def _hashes(rows: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """Lists of hashes, null as empty."""
    return [np.zeros(0, np.uint64) if v is None else np.array(v, np.int64).view(np.uint64) for v in rows.column(name).to_pylist()]


def _is_copy(rows: pa.RecordBatch) -> list[bool]:
    return [v is not None and t in v for t, v in zip(rows.column("_text").to_pylist(), rows.column("_copies").to_pylist())]


def _next_level(texts: DataFrame, marks: DataFrame, short: int, length: int, dense: bool) -> DataFrame:
    """(h, g, doc_id): windows of ``length`` words that extend surviving ones, without those of whole copies."""

    def extended(rows, data, bounds):
        words = split(data, bounds)
        a, b = _values(words)
        alive = [np.zeros(0, np.uint64) if copy else kept for copy, kept in zip(_is_copy(rows), _hashes(rows, "_alive"))]
        at = _covered(words, a, short, length, alive, dense)
        h, g = run_hashes(a, at, at + length, 0), run_hashes(b, at, at + length, 1)
        owner = words.owner()[at] if len(at) else np.zeros(0, np.int64)
        order = np.lexsort((h, owner))
        first = np.ones(len(order), bool)
        first[1:] = (owner[order][1:] != owner[order][:-1]) | (h[order][1:] != h[order][:-1])
        pick = order[first]
        ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
        return pa.record_batch(
            {"h": signed(h[pick]), "g": (g[pick] >> np.uint64(32)).astype(np.uint32).view(np.int32), "doc_id": ids[owner[pick]].astype(np.int64)}
        )

    return per_chunk(texts.join(marks, "doc_id"), "h long, g int, doc_id long", extended)


def _by_document(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.collect_set("h").alias(name))


def _whole_copies(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, _copies): hashes of a document's texts of ``window`` words or more whose word sequence a smaller doc_id has."""

    def sequence(rows, data, bounds):
        words = split(data, bounds)
        a, b = _values(words)
        lo, hi = words.firsts[:-1], words.firsts[1:]
        long = np.flatnonzero(hi - lo >= window)
        return pa.record_batch(
            {
                "doc_id": rows.column("doc_id").take(pa.array(long)),
                "_text": rows.column("_text").take(pa.array(long)),
                "a": signed(run_hashes(a, lo[long], hi[long], 0)),
                "b": signed(run_hashes(b, lo[long], hi[long], 1)),
            }
        )

    sequences = per_chunk(texts, "doc_id long, _text long, a long, b long", sequence)
    first = sequences.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return sequences.join(first, ["a", "b"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set("_text").alias("_copies"))


def remove_repeats(docs: DataFrame, window: int = 50, seed: int = SEED_WORDS, keep_text: bool = True) -> DataFrame:
    """``docs`` with every word removed that a window shared with a smaller doc_id covers.

    Adds n_words, n_removed and kept_sha256 (of the kept words joined by one space). With ``keep_text``, ``text`` becomes the
    kept words joined by one space where words were removed and stays as it was elsewhere; without it, ``text`` goes.
    """
    docs = long_ids(without(docs, *ADDED, "_text", "_copies", "_alive", "_repeated"))
    # every use of this table takes all of its columns: the joins on doc_id below then share one shuffle of the texts
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("_text", F.xxhash64("text"))
    texts = named.select("doc_id", "_text", "text")
    copies = checkpointed(_whole_copies(texts, window))

    steps = lengths(window, seed)
    if len(steps) == 1:
        steps = [window, window]
    rows = _first_level(texts, steps[0], steps[1])
    repeated = rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    alive = rows.join(repeated.select("h"), "h")
    for level, (short, length) in enumerate(zip(steps, steps[1:])):
        marks = _by_document(alive, "_alive").join(copies, "doc_id", "left")
        rows = _next_level(named, marks, short, length, dense=level > 0)
        repeated = rows.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        alive = rows.join(repeated, ["h", "g"])
    removed = _by_document(alive.where("doc_id > first"), "_repeated")

    marked = named.join(removed.join(copies, "doc_id", "full"), "doc_id", "left")
    unnamed = docs.where(F.col("doc_id").isNull()).withColumn("_text", F.lit(0).cast("long"))
    return _cut(marked.unionByName(unnamed, allowMissingColumns=True), window, keep_text)


def _cut(marked: DataFrame, window: int, keep_text: bool) -> DataFrame:
    kept_columns = [f for f in marked.schema.fields if f.name not in ("_text", "_copies", "_repeated") and (keep_text or f.name != "text")]
    schema = T.StructType(
        [*kept_columns, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    )

    def cut(rows, data, bounds):
        words = split(data, bounds)
        values = words.hashes(0)
        starts, h = window_hashes(words, values, window)
        keep = np.ones(len(values) + 1, bool)
        copy, repeated = _is_copy(rows), _hashes(rows, "_repeated")
        for i, (lo, hi) in enumerate(zip(words.firsts[:-1], words.firsts[1:])):
            if copy[i]:
                keep[lo:hi] = False
            elif len(repeated[i]):
                a, b = np.searchsorted(starts, (lo, hi))
                at = starts[a:b][np.isin(h[a:b], repeated[i])]
                change = np.zeros(hi - lo + 1, np.int64)
                np.add.at(change, at - lo, 1)
                np.add.at(change, at - lo + window, -1)
                keep[lo:hi] = np.cumsum(change[:-1]) == 0
        total = np.concatenate([[0], np.cumsum(~keep[: len(values)])])
        n_removed = total[words.firsts[1:]] - total[words.firsts[:-1]]
        digests, texts = [], []
        original = rows.column("text")
        for i, (lo, hi) in enumerate(zip(words.firsts[:-1], words.firsts[1:])):
            if n_removed[i]:
                joined = b" ".join([words.data[words.starts[k] : words.ends[k]].tobytes() for k in np.flatnonzero(keep[lo:hi]) + lo])
            else:
                joined = b" ".join(data[bounds[i] : bounds[i + 1]].tobytes().split())
            digests.append(hashlib.sha256(joined).hexdigest())
            texts.append(joined.decode("utf-8", "replace") if n_removed[i] else original[i].as_py() if keep_text else None)
        out = {f.name: rows.column(f.name) for f in kept_columns}
        if keep_text:
            out["text"] = pa.array(texts, pa.string())
        return pa.record_batch(out | {"n_words": words.counts.astype(np.int64), "n_removed": n_removed.astype(np.int64), "kept_sha256": digests})

    return per_chunk(marked, schema, cut)
