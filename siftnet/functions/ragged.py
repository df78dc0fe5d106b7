"""Binary fields of many payloads at once: big-endian reads, cuts and walks over the payloads of one Arrow batch.

A payload is a range of one byte array. Reads take an array of places; a place that a payload does not hold reads as absent. A
walk over items whose length stands in the data goes through all payloads in step, so its cost is the number of items, and the
interpreter is entered once per step instead of once per item.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Payloads:
    """``data[starts[i]:ends[i]]`` is the i-th payload; an absent one is empty."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, array: pa.Array) -> Payloads:
        width = np.int64 if pa.types.is_large_binary(array.type) else np.int32
        _, offsets, values = array.buffers()
        if offsets is None or len(array) == 0:
            bounds = np.zeros(len(array) + 1, np.int64)
        else:
            bounds = np.frombuffer(offsets, width)[array.offset : array.offset + len(array) + 1].astype(np.int64)
        # a byte behind the last one keeps every clipped place readable
        data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(1, np.uint8)
        ends = bounds[1:].copy()
        if array.null_count:
            absent = array.is_null().to_numpy(zero_copy_only=False)
            ends[absent] = bounds[:-1][absent]
        return cls(data, bounds[:-1], ends)

    def number(self, at: np.ndarray, width: int, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned numbers of ``width`` bytes, and whether they lie before ``end`` and below 2**63; others read 0."""
        held = at + width <= end
        value = unsigned(self.data, np.where(held, at, 0), width)
        if width == 8:
            held &= value >= 0
        return np.where(held, value, 0), held


def unsigned(data: np.ndarray, at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Big-endian numbers of one width or of a width each (up to 8), as signed 64-bit values of the same bits."""
    if isinstance(width, (int, np.integer)) and width in (1, 2, 4, 8) and len(at) and at.min() >= 0 and at.max() + width <= len(data):
        return _bytes_at(data, at, int(width)).view(f">u{width}")[:, 0].astype(np.uint64).view(np.int64)
    value = np.zeros(len(at), np.uint64)
    last = len(data) - 1
    if isinstance(width, (int, np.integer)):
        for i in range(width):
            value = (value << np.uint64(8)) | data[np.minimum(at + i, last)]
    else:
        for i in range(int(width.max(initial=0))):
            value = np.where(i < width, (value << np.uint64(8)) | data[np.minimum(at + i, last)], value)
    return value.view(np.int64)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: the group of every member, and its number inside it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The byte ranges as a BINARY array, null where not ``valid``."""
    if valid is not None:
        lengths = np.where(valid, lengths, 0)
    owner, inside = spread(lengths)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    content = data[starts[owner] + inside]
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(starts), [mask, pa.py_buffer(offsets), pa.py_buffer(content)])


def addresses(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Addresses of 4 or 16 bytes as text (the form of ``net.ip_from_bytes``); null for other lengths and where not ``valid``."""
    long, four = valid & (lengths == 16), valid & (lengths == 4)
    sixteen = np.flatnonzero(long)
    words = _bytes_at(data, starts[sixteen], 16)
    mapped = ~words[:, :10].any(axis=1) & (words[:, 10:12] == 255).all(axis=1)
    texts = np.zeros((len(starts), _GROUPS if len(sixteen) else _QUADS), np.uint8)
    if mapped.any():
        texts[sixteen[mapped], :_QUADS] = _quads(words[mapped, 12:])
        sixteen, words = sixteen[~mapped], words[~mapped]
    if len(sixteen) == len(starts):
        texts = _groups(words)
    elif len(sixteen):
        texts[sixteen] = _groups(words)
    if four.all():
        texts = _quads(_bytes_at(data, starts, 4))
    elif four.any():
        texts[four, :_QUADS] = _quads(_bytes_at(data, starts[four], 4))
    # a character that is not shown is 0
    shown = texts != 0
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(shown.sum(axis=1, dtype=np.int32), out=offsets[1:])
    mask = pa.py_buffer(np.packbits(long | four, bitorder="little"))
    return pa.Array.from_buffers(pa.string(), len(starts), [mask, pa.py_buffer(offsets), pa.py_buffer(texts[shown])])


def _bytes_at(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` bytes for each place; all of them lie in the data."""
    if len(data) < width:
        return np.zeros((0, width), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, width)[starts]


_QUADS, _GROUPS = 16, 41


def _written(values: int, base: int, digits: int, end: str) -> np.ndarray:
    """The texts of all numbers below ``values``, four characters each, as one number: digits without leading zeros (0 where not shown)."""
    number, texts = np.arange(values), np.zeros((values, 4), np.uint8)
    for place in range(digits):
        unit = base ** (digits - 1 - place)
        texts[:, place] = np.where((number >= unit) | (unit == 1), np.frombuffer(b"0123456789abcdef", np.uint8)[number // unit % base], 0)
    if end:
        texts[:, digits] = ord(end)
    return texts.view(np.uint32)[:, 0]


_OCTET_TEXT, _GROUP_TEXT = _written(256, 10, 3, "."), _written(65536, 16, 4, "")


def _quads(octets: np.ndarray) -> np.ndarray:
    """Dotted quads: four times three digits and a dot, the last of which is not shown."""
    texts = _OCTET_TEXT[octets].view(np.uint8)
    texts[:, -1] = 0
    return texts


def _groups(octets: np.ndarray) -> np.ndarray:
    """IPv6 texts: eight times a colon and four digits, and a colon; the first longest run of two or more zero groups is shortened."""
    groups = np.ascontiguousarray(octets).view(">u2").astype(np.int64)
    texts = np.zeros((len(groups), _GROUPS), np.uint8)
    pairs = texts[:, :40].reshape(len(groups), 8, 5)
    pairs[:, 1:, 0] = ord(":")
    pairs[:, :, 1:] = _GROUP_TEXT[groups].view(np.uint8).reshape(len(groups), 8, 4)
    zero = groups == 0
    some = np.flatnonzero((zero[:, 1:] & zero[:, :-1]).any(axis=1))
    if len(some):
        run = np.zeros((len(some), 9), np.int64)
        for i in range(8):
            run[:, i] = np.where(zero[some, i], run[:, i - 1] + 1, 0)
        last = run.argmax(axis=1)
        first = last - run[np.arange(len(some)), last] + 1
        place = np.arange(8)
        inside = (first[:, None] <= place) & (place <= last[:, None])
        cut = pairs[some]
        cut[inside] = 0
        cut[np.arange(len(some)), first, 0] = ord(":")
        texts[some, :40] = cut.reshape(len(some), 40)
        texts[some, 40] = np.where(last == 7, ord(":"), 0)
    return texts


def numbers(values: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    return pa.array(values, pa.int64(), mask=None if valid is None else ~valid)


@dataclass
class Items:
    """Items found by :func:`items`: the payload of each, its number there, its tag and its bytes; and payloads that broke off."""

    owner: np.ndarray
    number: np.ndarray
    tag: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    broken: np.ndarray

    def __getitem__(self, chosen: np.ndarray) -> Items:
        return Items(self.owner[chosen], self.number[chosen], self.tag[chosen], self.starts[chosen], self.ends[chosen], self.broken)


def items(
    payloads: Payloads, at: np.ndarray, ends: np.ndarray, most: np.ndarray | None, *, width: int, whole: bool
) -> Items:
    """Walk lists of (tag, length, body), each number of ``width`` bytes, in data[at:end].

    ``most``: items of a list, all that fit if None. ``whole``: the length counts the item's own head. A list is broken where an item
    does not fit; what remains is too short for a head is broken only for lists with a number of items.
    """
    head = 2 * width
    active, offset = np.arange(len(at)), at.copy()
    left = None if most is None else most.copy()
    broken = np.zeros(len(at), bool)
    found = []
    step = 0
    while len(active):
        begin, end = offset[active], ends[active]
        if left is None:
            going = begin + head <= end
        else:
            going = (begin < end) & (left[active] > 0)
            short = going & (begin + head > end)
            broken[active[short]] = True
            going &= ~short
        active, begin, end = active[going], begin[going], end[going]
        tag = unsigned(payloads.data, begin, width)
        length = unsigned(payloads.data, begin + width, width)
        body = length - head if whole else length
        fits = (body >= 0) & (begin + head + body <= end)
        broken[active[~fits]] = True
        active, begin, tag, body = active[fits], begin[fits], tag[fits], body[fits]
        found.append((active, np.full(len(active), step), tag, begin + head, begin + head + body))
        offset[active] = begin + head + body
        if left is not None:
            left[active] -= 1
        step += 1
    columns = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
    order = np.lexsort((columns[1], columns[0]))
    return Items(*[c[order] for c in columns], broken)
