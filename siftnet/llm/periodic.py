"""Periodic runs of words, found by block convolution at dyadic scales.

A run is a longest stretch of consecutive words of one text in which words ``q`` apart are identical, with ``q`` its smallest
period and a length of at least ``least`` words and ``exponent * q`` words. Every run is found, whatever its period.

* At scale ``b`` (1, 2, 4, ...) a text is cut into blocks of ``b`` words, and each block is looked for at the distances ``b`` to
  ``2b - 1`` behind it. A run of a period in that range is long enough to hold a whole block together with the next period.
* The sum of squared differences between a block and its following window, at all these distances at once, is one cyclic
  correlation, done by a number-theoretic transform modulo primes whose product exceeds the largest possible sum. A sum is
  zero exactly where the block occurs again, so this step neither errs nor misses.
* Before that, a block is set aside if one of its words does not come again at any of the distances.
* A distance seeds an extension to both sides: longest equal stretches by halving steps over prefix hashes, then compared word by
  word. Occurrences that lie inside a run of a shorter period are multiples of that period (Fine and Wilf) and seed nothing, so a
  long run costs its length, not its square.

Everything happens inside a row's task; nothing is shuffled, so hot sources and copies make no difference. A task holds about
``words.CHUNK_BYTES`` of text, or one text if that is longer.

Rows and edge cases: null, empty and blank texts have no words and no runs, and an empty collapsed text; rows with a null or
repeated doc_id are rows like others; input columns named like the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftnet.llm.words import RunHasher, mix, per_chunk, split, without, word_ids

ADDED = ("n_words", "runs", "collapsed")
#: Primes of the form k * 2**m + 1 below 2**31 with a generator each: products of residues fit into 64 bits.
PRIMES = ((2013265921, 31, 27), (469762049, 3, 26), (1811939329, 13, 26), (167772161, 3, 25))
#: Values transformed at once.
BATCH_VALUES = 1 << 19
#: Scales up to this one are sifted by comparing shifted words, larger ones by looking places up.
SHIFTED = 8


# ------------------------------------------------------------------------------------------- number-theoretic transform


def _roots(prime: int, generator: int, size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a primitive root of unity of order ``size``."""
    root = pow(generator, (prime - 1) // size, prime)
    if inverse:
        root = pow(root, -1, prime)
    powers = np.ones(max(size // 2, 1), np.uint64)
    filled, factor = 1, root
    while filled < len(powers):
        more = min(filled, len(powers) - filled)
        powers[filled : filled + more] = powers[:more] * np.uint64(factor) % np.uint64(prime)
        filled, factor = filled + more, factor * factor % prime
    return powers


def transform(rows: np.ndarray, prime: int, generator: int, inverse: bool = False) -> np.ndarray:
    """The transform of every row (a power of two of residues), in natural order."""
    count, size = rows.shape
    p, roots = np.uint64(prime), _roots(prime, generator, size, inverse)
    state, left, run = rows.reshape(count, size, 1), size, 1
    while left > 1:
        half = left // 2
        low, high = state[:, :half], state[:, half:]
        turned = np.empty((count, half, 2, run), np.uint64)
        turned[:, :, 0] = (low + high) % p
        turned[:, :, 1] = (low + p - high) * roots[::run][:half].reshape(1, half, 1) % p
        state, left, run = turned.reshape(count, half, 2 * run), half, 2 * run
    state = state.reshape(count, size)
    return state * np.uint64(pow(size, -1, prime)) % p if inverse else state


def _zero_residues(block: np.ndarray, window: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Whether the sum of squared differences of each block and its window at shifts 0 .. b - 1 is a multiple of ``prime``."""
    p = np.uint64(prime)
    b = block.shape[1]
    block, window = block % p, window % p
    padded = np.zeros_like(window)
    padded[:, 0] = block[:, 0]
    padded[:, b + 1 :] = block[:, :0:-1]  # block[i] at place -i, so that the product correlates
    product = transform(padded, prime, generator) * transform(window, prime, generator) % p
    common = transform(product, prime, generator, inverse=True)[:, :b]
    squares = window * window % p
    sums = np.zeros((len(window), 2 * b + 1), np.uint64)
    np.cumsum(squares, axis=1, out=sums[:, 1:])
    theirs = (sums[:, b : 2 * b] - sums[:, :b]) % p
    own = (block * block % p).sum(axis=1, dtype=np.uint64) % p
    return (own[:, None] + theirs + p + p - common - common) % p == 0


def occurrences(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``starts``, distance) of every occurrence of values[s:s+b] at a distance of b .. 2b - 1, inside its text.

    ``ends`` are the ends of the texts; values are positive.
    """
    found_block, found_distance = [], []
    step = max(1, BATCH_VALUES // (2 * b))
    inner, outer = np.arange(b), np.arange(b, 3 * b)
    for lo in range(0, len(starts), step):
        s, e = starts[lo : lo + step], ends[lo : lo + step]
        at = s[:, None] + outer
        inside = at < e[:, None]
        window = np.where(inside, values[np.where(inside, at, 0)], 0).astype(np.uint64)  # 0 equals no value
        block = values[s[:, None] + inner].astype(np.uint64)
        largest = int(max(block.max(), window.max()))
        zero, product = np.ones((len(s), b), bool), 1
        for prime, generator, order in PRIMES:
            if product > b * largest * largest:
                break
            if 2 * b > 1 << order:
                raise ValueError("a text of more than 2**26 words")
            zero &= _zero_residues(block, window, prime, generator)
            product *= prime
        i, shift = np.nonzero(zero)
        found_block.append(i + lo)
        found_distance.append(shift + b)
    if not found_block:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_block), np.concatenate(found_distance)


# ----------------------------------------------------------------------------------------------------------------- runs


class _Places:
    """Where the words of all texts occur: answers whether a word comes again at a distance of b .. 2b - 1."""

    def __init__(self, numbers: np.ndarray):
        self.numbers, self.scale = numbers, len(numbers) + 1
        self.keys = np.sort(numbers * self.scale + np.arange(len(numbers)))

    def again(self, at: np.ndarray, b: int) -> np.ndarray:
        here = self.numbers[at] * self.scale + at
        found = np.searchsorted(self.keys, here + b)
        return self.keys[np.minimum(found, len(self.keys) - 1)] - here - b < b if len(at) else np.zeros(0, bool)


def _sifted(places: _Places, starts: np.ndarray, b: int) -> np.ndarray:
    """Blocks all of whose words come again at one of the distances: a necessary condition, tested until little is left."""
    numbers = places.numbers
    if b <= SHIFTED:
        again = np.zeros(len(numbers), bool)
        for d in range(b, 2 * b):
            if d < len(numbers):
                again[:-d] |= numbers[:-d] == numbers[d:]
        total = np.concatenate([[0], np.cumsum(again)])
        return starts[total[starts + b] - total[starts] == b]
    for offset in range(b):
        if not len(starts):
            break
        alive = places.again(starts + offset, b)
        # a word in sixteen of what is left fails at most: the transform is now the cheaper test
        stop = offset >= 16 and alive.sum() * 16 > len(starts) * 15
        starts = starts[alive]
        if stop:
            break
    return starts


def _extended(hasher: RunHasher, a: np.ndarray, b: np.ndarray, room: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from a and b on (or before them) agree, at most ``room``."""
    reach = np.zeros(len(a), np.int64)
    step = 1 << max(int(room.max()).bit_length() - 1, 0) if len(a) else 0
    while step:
        able = np.flatnonzero(reach + step <= room)
        if forward:
            x, y = a[able] + reach[able], b[able] + reach[able]
        else:
            x, y = a[able] - reach[able] - step, b[able] - reach[able] - step
        same = hasher(x, x + step) == hasher(y, y + step)
        reach[able[same]] += step
        step //= 2
    return reach


def _exact(numbers: np.ndarray, lo: int, hi: int, d: int, s: int) -> tuple[int, int]:
    """The stretch of period d around s, word by word, should prefix hashes have been equal by chance."""
    differ = np.flatnonzero(numbers[lo : hi - d] != numbers[lo + d : hi])
    if len(differ):
        below, above = differ[differ + lo < s], differ[differ + lo >= s]
        lo, hi = (lo + int(below[-1]) + 1 if len(below) else lo), (lo + int(above[0]) + d if len(above) else hi)
    return lo, hi


def find_runs(numbers: np.ndarray, firsts: np.ndarray, least: int = 6, exponent: int = 4) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period. Equal words of one text have equal numbers; words of different
    texts never do. ``firsts`` are the starts of the texts, and the end of the last one."""
    if exponent < 3:
        raise ValueError("a block and its next period fit into a run from three periods on")
    places = _Places(numbers)
    hasher = RunHasher(mix(numbers.astype(np.uint64) + np.uint64(1)))
    begin, end = firsts[:-1], firsts[1:]
    # numbers counted from 1 inside each text keep the sums small
    low = np.minimum.reduceat(numbers, begin[end > begin]) if len(numbers) else np.zeros(0, np.int64)
    values = numbers - np.repeat(low, (end - begin)[end > begin]) + 1
    runs = np.zeros((0, 3), np.int64)
    longest, b = int((end - begin).max(initial=0)), 1
    while longest >= max(least, exponent * b):
        able = end - begin >= max(least, exponent * b)
        lo, hi = begin[able], end[able]
        blocks = np.maximum((hi - lo) // b - 1, 0)  # the block and its next period fit into the text
        first = np.repeat(lo, blocks)
        starts = first + (np.arange(len(first)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * b
        known = np.zeros(len(numbers) + 1, np.int64)  # how far a run of a shorter period that begins here or before reaches
        np.maximum.at(known, runs[:, 0], runs[:, 1])
        known = np.maximum.accumulate(known)
        text_end = np.repeat(hi, blocks)
        starts = starts[known[starts] < np.minimum(starts + 3 * b - 1, text_end)]
        starts = _sifted(places, starts, b)
        text = np.searchsorted(firsts, starts, "right") - 1
        at, d = occurrences(values, starts, end[text], b)
        s, text = starts[at], text[at]
        new = known[s] < s + b + d
        s, d, text = s[new], d[new], text[new]
        if len(s):
            ahead = _extended(hasher, s, s + d, end[text] - s - d, True)
            back = _extended(hasher, s, s + d, s - begin[text], False)
            found = np.stack([s - back, s + d + ahead, d, s], axis=1)
            enough = found[:, 1] - found[:, 0] >= np.maximum(least, exponent * d)
            found = found[enough & (known[found[:, 0]] < found[:, 1])]
            _, one = np.unique(found[:, :3], axis=0, return_index=True)
            exact = [(*_exact(numbers, x, y, q, at_), q) for x, y, q, at_ in found[one].tolist()]
            kept = [r for r in exact if r[1] - r[0] >= max(least, exponent * r[2])]
            runs = np.unique(np.concatenate([runs, np.array(kept, np.int64).reshape(-1, 3)]), axis=0)
        b *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def numbered(data: np.ndarray, bounds: np.ndarray):
    """The words of a chunk, and a number for each that is equal for equal words of one text only."""
    words = split(data, bounds)
    owner = words.owner()
    ids = word_ids(words)
    keys = owner * (int(ids.max(initial=0)) + 1) + ids
    return words, np.unique(keys, return_inverse=True)[1].astype(np.int64).reshape(-1)


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """``docs`` with n_words, ``runs`` (start, length and period in words, by start and period) and ``collapsed``: the words
    joined by one space, without those that a run holds behind its first period."""
    docs = without(docs, *ADDED)
    run_type = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_type)), T.StructField("collapsed", T.StringType())]
    )

    def find(rows, data, bounds):
        words, numbers = numbered(data, bounds)
        runs = find_runs(numbers, words.firsts, least, exponent)
        per_text = np.searchsorted(runs[:, 0], words.firsts)
        change = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 1], -1)
        keep = np.cumsum(change[:-1]) == 0
        texts = []
        for i, (lo, hi) in enumerate(zip(words.firsts[:-1], words.firsts[1:])):
            if per_text[i] == per_text[i + 1]:
                kept = data[bounds[i] : bounds[i + 1]].tobytes().split()
            else:
                kept = [words.data[words.starts[k] : words.ends[k]].tobytes() for k in np.flatnonzero(keep[lo:hi]) + lo]
            texts.append(b" ".join(kept))
        base = np.repeat(words.firsts[:-1], np.diff(per_text))
        fields = [runs[:, 0] - base, runs[:, 1] - runs[:, 0], runs[:, 2]]
        listed = pa.ListArray.from_arrays(
            pa.array(per_text, pa.int32()), pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], names=["start", "length", "period"])
        )
        out = {name: rows.column(name) for name in rows.schema.names}
        return pa.record_batch(out | {"n_words": words.counts.astype(np.int64), "runs": listed, "collapsed": pa.array(texts, pa.binary()).cast(pa.string())})

    return per_chunk(docs, schema, find)
