"""Benchmark decontamination under word edit distance.

A document is contaminated by an item of m words if one of its windows is within k = floor(m * (100 - percent) / 100) word edits
of it. With ``free_end`` these are windows of every size from m - k to m + k words; without it windows of m words, in which the
words that an insertion pushes out, or a deletion pulls in, are paid as well. Words are lower-cased runs of ASCII letters and digits and of bytes beyond ASCII, so case and punctuation don't count.

1. Windows that cannot match are left out without loss: of k + 1 consecutive pieces of an item one is untouched by k edits, so only
   windows that hold a piece, moved by at most k words, are embedded. This looks at every position of every text.
2. Each window and each item of its size is embedded by CGK random walks: a walk copies the word under its pointer and moves on
   or stays by a random function of (step, word), 3 * m steps long. Small edit distance becomes small Hamming distance.
3. Bit-sampling LSH: a repetition hashes a few sampled places of its own walk; window and item are a candidate pair if they agree
   in any. The number of repetitions is set for each item size so that a window at the largest distance is found with probability
   ``RECALL``, measured on edited copies of the items of that size. Sizes for which the most repetitions don't reach it skip
   2 and 3: all their pairs of an item and a window that holds one of its pieces are candidates.
4. Candidates are verified by the exact edit distance; with ``free_end`` to the best end within the m + k words from their start.

The benchmark is taken in blocks of at most ``BLOCK_ITEMS`` items, each sent to all tasks; the texts are read once a block.

Rows and edge cases: null and empty texts and items match nothing; items of fewer than ``LEAST_WORDS`` words take no part; equal
items are both reported; repeated rows are reported each. Near the ends of a text a window may be up to k words shorter.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftnet.llm.words import long_ids, mix, per_chunk, run_hashes, split

#: Chance that a window at the largest distance becomes a candidate; sampled places per hash; most repetitions.
RECALL, PLACES, MOST_REPETITIONS = 0.995, 3, 64
#: Numbers of repetitions that a size may get.
LEVELS = (8, 16, 32, MOST_REPETITIONS)
#: Windows embedded at once, and numbers held at once while they are embedded or verified; pairs from which on all are verified at once.
SLICE_ROWS, SLICE_CELLS, MANY_PAIRS = 512, 1 << 22, 64
BLOCK_ITEMS, LEAST_WORDS = 20_000, 5
#: Words end at ASCII bytes that are neither letters nor digits.
WORD_END = np.ones(256, bool)
WORD_END[0x30:0x3A] = WORD_END[0x41:0x5B] = WORD_END[0x61:0x7B] = False
WORD_END[0x80:] = False


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return split(data, np.array([0, len(data)]), lower=True, separator=WORD_END).hashes()


def walk(sequences: np.ndarray, lengths: np.ndarray, steps: int, repetitions: int) -> np.ndarray:
    """CGK embeddings (step x row x repetition) of rows of word hashes, each repetition by walks of its own; past its length a
    row reads 0."""
    n, width = sequences.shape
    at, rows = np.zeros((n, repetitions), np.int64), np.arange(n)[:, None]
    out = np.zeros((steps, n, repetitions), np.uint64)
    turns = mix(np.arange(1, steps * MOST_REPETITIONS + 1, dtype=np.uint64)).reshape(steps, -1)[:, :repetitions] | np.uint64(1)
    for t in range(steps):
        word = sequences[rows, np.minimum(at, width - 1)]
        inside = at < lengths[:, None]
        out[t] = word * inside
        # the top bit of a product with a random odd number says whether the pointer moves
        at += ((word * turns[t]) >> np.uint64(63)).astype(np.int64) & inside
    return out


@cache
def sampled(size: int) -> np.ndarray:
    """Places (repetition x PLACES) of the embedding of items of a size that a repetition looks at."""
    steps = 3 * size
    return np.array([sorted(random.Random(seed * 7919 + steps).sample(range(steps), PLACES)) for seed in range(MOST_REPETITIONS)])


def lsh_hashes(sequences: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, repetitions: int) -> np.ndarray:
    """Hash (row x repetition) of the sampled places; size and repetition enter it. Rows go in slices of similar size."""
    out = np.zeros((len(sequences), repetitions), np.uint64)
    order = np.argsort(sizes, kind="stable")
    numbers = np.arange(repetitions)
    lo = 0
    while lo < len(order):
        widest = int(sizes[order[min(lo + SLICE_ROWS, len(order)) - 1]])
        part = order[lo : lo + min(SLICE_ROWS, max(1, SLICE_CELLS // (3 * widest * repetitions)))]
        lo += len(part)
        width = int(sizes[part[-1]])
        embedded = walk(sequences[part, :width], lengths[part], 3 * width, repetitions)
        places = np.stack([sampled(int(size))[:repetitions] for size in sizes[part]])
        h = mix((sizes[part][:, None] * MOST_REPETITIONS + numbers + 1).astype(np.uint64))
        for place in range(PLACES):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + embedded[places[:, :, place], np.arange(len(part))[:, None], numbers])
        out[part] = h
    return out


def edit_distance(a: list[int], b: list[int], most: int, free_end: bool = False) -> int:
    """Word edit distance, or most + 1 if it is larger; only the diagonal band of that width is filled. With ``free_end`` the
    distance of ``a`` to the closest beginning of ``b``."""
    if a == (b[: len(a)] if free_end else b):
        return 0
    big = most + 1
    if len(a) - len(b) > most or (len(b) - len(a) > most and not free_end):
        return big
    row = [j if j <= most else big for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [big] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(low, high + 1):
            value = row[j - 1] + (x != b[j - 1])
            if row[j] + 1 < value:
                value = row[j] + 1
            if new[j - 1] + 1 < value:
                value = new[j - 1] + 1
            new[j] = value if value < big else big
        if min(new[low - 1 : high + 1]) > most:
            return big
        row = new
    return min(row) if free_end else row[len(b)]


def _padded(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one width, 0 past their ends, and their lengths."""
    lengths = np.array([len(x) for x in lists])
    rows = np.zeros((len(lists), int(lengths.max())), np.uint64)
    for row, values in zip(rows, lists):
        row[: len(values)] = values
    return rows, lengths


def distances(items: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int, free_end: bool) -> np.ndarray:
    """``edit_distance`` of each row of ``items`` (of one size) and the window at its start, all at once."""
    size, out = items.shape[1], np.full(len(items), most + 1)
    band, step = np.arange(-most, most + 1), max(1, SLICE_CELLS // (size + 2 * most))
    for lo in range(0, len(items), step):
        rows = np.arange(lo, min(lo + step, len(items)))
        long = np.minimum(ends[rows] - starts[rows], size + (most if free_end else 0))
        rows, long = rows[long >= size - most], long[long >= size - most]
        # words of the window from -most on, so that the band of step i begins at column i - 1
        at = np.arange(-most, size + most)
        inside = (at >= 0) & (at < long[:, None])
        near = values[np.clip(starts[rows][:, None] + at, 0, len(values) - 1)]
        row = np.broadcast_to(np.where(band >= 0, band, most + 1), (len(rows), len(band))).copy()
        row[band > long[:, None]] = most + 1
        for i in range(1, size + 1):
            new = row + (near[:, i - 1 : i + 2 * most] != items[rows, i - 1][:, None])
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
            new[~inside[:, i - 1 : i + 2 * most]] = most + 1
            if i <= most:
                new[:, most - i] = i
            row = np.minimum(np.minimum.accumulate(new - band, axis=1) + band, most + 1)
            row[band + i > long[:, None]] = most + 1
            if i % 8 == 0:
                alive = row.min(axis=1) <= most
                rows, long, near, inside, row = rows[alive], long[alive], near[alive], inside[alive], row[alive]
        out[rows] = row.min(axis=1) if free_end else row[np.arange(len(rows)), long - size + most]
    return out


def edited_copy(rng: random.Random, words: list[int], edits: int) -> list[int]:
    """A window of as many words as the item, at a copy with so many edits in foreign words."""
    copy = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(copy)), rng.random()
        if kind < 0.6:
            copy[at] = rng.getrandbits(64)
        elif kind < 0.8:
            copy.insert(at, rng.getrandbits(64))
        elif len(copy) > 1:
            copy.pop(at)
    return (copy + [rng.getrandbits(64) for _ in range(edits)])[: len(words)]


def repetitions(items: list[np.ndarray], percent: int, recall: float = RECALL) -> int:
    """The level of repetitions that reaches the recall for items of one size, or 0 if none does: it finds each of so many copies with
    most edits that a lower recall would lose one of them with a chance of 95 percent."""
    rng, size = random.Random(11), len(items[0])
    pairs = []
    for words in rng.choices(items, k=math.ceil(math.log(0.05) / math.log(recall))):
        pairs += [words.tolist(), edited_copy(rng, words.tolist(), size * (100 - percent) // 100)]
    rows, lengths = _padded(pairs)

    def finds(level: int, part: slice) -> bool:
        h = lsh_hashes(rows[part], lengths[part], np.repeat(size, len(rows[part])), level)
        return bool((h[::2] == h[1::2]).any(axis=1).all())

    parts = [slice(lo, lo + 200) for lo in range(0, len(rows), 200)]
    return next((level for level in LEVELS if all(finds(level, part) for part in parts)), 0)


def _matching(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (number in ``asked``, number in ``known``) of equal values; ``known`` is ascending."""
    left = np.searchsorted(known, asked, "left")
    hit = np.flatnonzero(known[np.minimum(left, len(known) - 1)] == asked)
    many = np.searchsorted(known, asked[hit], "right") - left[hit]
    return np.repeat(hit, many), np.repeat(left[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())


class Index:
    """A block of items: their pieces by length, and their LSH hashes by size and repetition."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        found = [(i, word_hashes(text)) for i, text in items if text]
        found = [(i, w) for i, w in found if len(w) >= LEAST_WORDS]
        self.ids, self.words = [i for i, _ in found], [w for _, w in found]
        self.lists = [w.tolist() for w in self.words]
        self.edits = [len(w) * (100 - percent) // 100 for w in self.words]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.repetitions = {}
        for size in np.unique(self.sizes).tolist():
            self.repetitions[size] = repetitions([self.words[n] for n in np.flatnonzero(self.sizes == size)], percent)
        pieces: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for n, (w, k) in enumerate(zip(self.words, self.edits)):
            cuts = np.linspace(0, len(w), k + 2).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:]):
                pieces[int(b - a)].append((int(run_hashes(w, np.array([a]), np.array([b]))[0]), n, int(a)))
        self.pieces = {}
        for length, rows in pieces.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            self.pieces[length] = (hashes, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        # by level: hashes of the items of the sizes that have it, ascending, and their items
        self.hashes = {}
        levels = np.array([self.repetitions[size] for size in self.sizes.tolist()], np.int64)
        for level in np.unique(levels[levels > 0]).tolist():
            mine = np.flatnonzero(levels == level)
            h = lsh_hashes(*_padded([self.lists[n] for n in mine]), self.sizes[mine], level).ravel()
            order = np.argsort(h, kind="stable")
            self.hashes[level] = h[order], mine[order // level]

    def windows(self, values: np.ndarray, firsts: np.ndarray, owner: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """By size: the starts of the windows that hold a piece of an item of that size, moved by at most its edits. Of sizes
        without LSH: (start, item)."""
        starts: dict[int, list[np.ndarray]] = defaultdict(list)
        exact = [np.zeros((0, 2), np.int64)]
        ends = firsts[1:][owner] if len(owner) else owner
        sizes, edits = self.sizes, np.array(self.edits)
        for length, (hashes, numbers, offsets) in self.pieces.items():
            at = np.arange(len(values))
            at = at[at + length <= ends]
            h = run_hashes(values, at, at + length)
            hit, row = _matching(hashes, h)
            place, number = at[hit], numbers[row]
            begin, size, k = place - offsets[row], sizes[number], edits[number]
            for s in np.unique(size):
                mine = np.flatnonzero(size == s)
                shift = np.arange(-int(k[mine[0]]), int(k[mine[0]]) + 1)
                text = owner[place[mine]]
                moved = begin[mine][:, None] + shift
                low, high = firsts[:-1][text][:, None], firsts[1:][text][:, None]
                moved = np.maximum(moved, low)
                fits = moved + (s - k[mine[0]]) <= high
                if self.repetitions[int(s)]:
                    starts[int(s)].append(moved[fits])
                else:
                    item = np.broadcast_to(number[mine][:, None], moved.shape)
                    exact.append(np.unique(np.stack([moved[fits], item[fits]], axis=1), axis=0))
        return {s: np.unique(np.concatenate(parts)) for s, parts in starts.items()}, np.unique(np.concatenate(exact), axis=0)

    def candidates(self, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(start, item) of windows and items of their size that agree in some repetition."""
        out = [np.zeros((0, 2), np.int64)]
        levels = np.array([self.repetitions[size] for size in sizes.tolist()], np.int64)
        for level in np.unique(levels).tolist():
            at, size = starts[levels == level], sizes[levels == level]
            lengths = np.minimum(ends[at] - at, size)
            steps = np.arange(int(size.max()))
            rows = np.where(steps < lengths[:, None], values[np.minimum(at[:, None] + steps, len(values) - 1)], np.uint64(0))
            hashes, items = self.hashes[level]
            window, number = _matching(hashes, lsh_hashes(rows, lengths, size, level).ravel())
            out.append(np.unique(np.stack([at[window // level], items[number]], axis=1), axis=0))
        return np.concatenate(out)

    def edits_of(self, values: np.ndarray, pairs: np.ndarray, ends: np.ndarray, free_end: bool) -> np.ndarray:
        """Edit distances of (start, item) pairs, or one more than the item's edits."""
        out = np.zeros(len(pairs), np.int64)
        size = self.sizes[pairs[:, 1]]
        for s in np.unique(size).tolist():
            mine = np.flatnonzero(size == s)
            starts, numbers = pairs[mine].T
            most = self.edits[numbers[0]]
            if len(mine) >= MANY_PAIRS:
                kinds, kind = np.unique(numbers, return_inverse=True)
                items = np.stack([self.words[n] for n in kinds])[kind]
                out[mine] = distances(items, values, starts, ends[starts], most, free_end)
                continue
            until = np.minimum(starts + s + (most if free_end else 0), ends[starts])
            out[mine] = [edit_distance(self.lists[n], values[a:b].tolist(), most, free_end) for a, b, n in zip(starts, until, numbers)]
        return out

    def matches(self, data: np.ndarray, bounds: np.ndarray, free_end: bool) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, edits): the closest window of each stretch of a text that matches an item."""
        words = split(data, bounds, lower=True, separator=WORD_END)
        values, owner = words.hashes(), words.owner()
        ends = words.firsts[1:][owner] if len(owner) else owner
        found, pairs = self.windows(values, words.firsts, owner)
        starts = np.concatenate([np.zeros(0, np.int64), *found.values()])
        if len(starts):
            sizes = np.repeat(list(found), [len(x) for x in found.values()])
            pairs = np.concatenate([pairs, self.candidates(values, starts, sizes, ends)])
        close: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for (start, n), d in zip(pairs.tolist(), self.edits_of(values, pairs, ends, free_end).tolist()):
            if d <= self.edits[n]:
                close[int(owner[start]), n].append((start - int(words.firsts[owner[start]]), d))
        out = []
        for (text, n), places in close.items():
            places.sort()
            while places:
                stretch = [p for p in places if p[0] < places[0][0] + len(self.lists[n])]
                places = places[len(stretch) :]
                first, d = min(stretch, key=lambda p: (p[1], p[0]))
                out.append((text, n, first, d))
        return sorted(out)


def _blocks(benchmark: DataFrame, percent: int, block_items: int) -> Iterator[Index]:
    """The benchmark's items in blocks of about ``block_items``, one in the driver at a time."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-items.count() // block_items))
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield Index([(r["item_id"], r["text"]) for r in mine.collect()], percent)


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, block_items: int = BLOCK_ITEMS, free_end: bool = False) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_edits): every place where a document holds an item; n_words are the item's."""
    docs = long_ids(docs.select("doc_id", "text"))
    return reduce(DataFrame.unionByName, [_search(docs, index, free_end) for index in _blocks(benchmark, percent, block_items)])


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, block_items: int = BLOCK_ITEMS, free_end: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no item. Texts are filtered where they are read and never shuffled."""
    for index in _blocks(benchmark, percent, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batch, data, bounds, shared=shared):
            held = shared.value
            keep = np.ones(batch.num_rows, bool)
            keep[[r[0] for r in held.matches(data, bounds, free_end)] if held.ids else []] = False
            return batch.filter(pa.array(keep))

        docs = per_chunk(docs, docs.schema, clean)
    return docs


def _search(docs: DataFrame, index: Index, free_end: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def search(batch, data, bounds):
        held = shared.value
        rows = held.matches(data, bounds, free_end) if held.ids else []
        return pa.record_batch(
            {
                "doc_id": batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())),
                "item_id": pa.array([held.ids[r[1]] for r in rows], pa.int64()),
                "first_word": pa.array([r[2] for r in rows], pa.int64()),
                "n_words": pa.array([len(held.words[r[1]]) for r in rows], pa.int64()),
                "n_edits": pa.array([r[3] for r in rows], pa.int64()),
            }
        )

    return per_chunk(docs, "doc_id long, item_id long, first_word long, n_words long, n_edits long", search)
