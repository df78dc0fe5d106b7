"""How far sources of one language diverge in their use of terms, with terms found by iceberg prefix refinement.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms that occur in at least
``min_docs`` of its documents.

* Refinement: byte prefixes are extended level by level, to 4, 8, 16, ... bytes. A level counts, for each language and prefix, the
  distinct documents that hold a term beginning with it, and discards those below the threshold with all that they begin. Terms no
  longer than a level's prefixes are complete and are kept or discarded there; the search ends when no longer term is left. A
  prefix is never rarer than its extensions, so no kept term is lost, and the many rare terms are never counted in full.
* Texts are read and cut into terms once, into blocks of about 16 MB of text: sorted terms, and for each the documents that hold
  it and how often. A document lies in one block, so counts of distinct documents add up. Levels read only blocks.
* Use of terms: p = 1 + floor(scale * (count + smooth) / (N + smooth * V)), for every (language, source) and language, V being the kept
  terms of the language and N their occurrences there. Exact: integers and decimals throughout.
* Pairs of sources: sums of |p - q| over all kept terms, in tiles of sources and slices of terms that bound a task's memory, however
  large a language or source. Terms that neither source of a tile holds contribute by multiplication.

A row counts as a document, also if its doc_id is null or repeated; null text, lang and source count as ''. An empty table gives no
rows. A language that keeps no term has pairs of value 0. Only the three columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.llm.words import chunks, small_batches, split, word_array
from siftnet.session import checkpointed

#: All ASCII but letters separates terms.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[:0x80] = True
SEPARATORS[0x41:0x5B] = False
SEPARATORS[0x61:0x7B] = False

#: Prefix bytes of the first level; each further level doubles them.
FIRST_PREFIX = 4
#: Bytes of text whose terms make a block.
BLOCK_BYTES = 16 << 20
#: Sources in a tile and kept terms in a slice: at most 2 * 128 * some 8,192 values in a task.
TILE_SOURCES, SLICE_TERMS = 128, 8192


# --------------------------------------------------------------------------------------------------------------- blocks


def packed(values: np.ndarray) -> bytes:
    """Non-negative numbers in the narrowest width that holds them, which the first byte tells."""
    narrow = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return bytes([narrow.itemsize]) + narrow.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


BLOCK = "langs array<string>, lang_terms binary, sources array<string>, doc_source binary, term_ends binary, terms binary, sizes binary, docs binary, counts binary"


class _Gathering:
    """Terms of the documents of one block, gathered chunk by chunk."""

    def __init__(self):
        self.bytes = self.n_docs = 0
        self.langs: dict[str, int] = {}
        self.sources: dict[str, int] = {}
        self.doc_lang, self.doc_source, self.terms, self.pairs = [], [], [], []

    def add(self, rows: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray) -> None:
        for name, known, of_docs in (("lang", self.langs, self.doc_lang), ("source", self.sources, self.doc_source)):
            of_docs.append(np.array([known.setdefault(v or "", len(known)) for v in rows.column(name).to_pylist()], np.int64))
        words = split(data, bounds, lower=True, separator=SEPARATORS)
        encoded = word_array(words, SEPARATORS).dictionary_encode()
        n = len(bounds) - 1
        keys = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + words.owner()
        keys, counts = np.unique(keys, return_counts=True)
        self.pairs.append((keys // n, keys % n + self.n_docs, counts))
        self.terms.append(encoded.dictionary)
        self.n_docs += n
        self.bytes += len(data)

    def block(self) -> pa.RecordBatch:
        encoded = pa.concat_arrays(self.terms).dictionary_encode()
        number = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = pc.sort_indices(encoded.dictionary).to_numpy().astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        firsts = np.cumsum([0, *[len(t) for t in self.terms]])
        term = np.concatenate([rank[number[first + t]] for first, (t, _, _) in zip(firsts, self.pairs)])
        doc = np.concatenate([d for _, d, _ in self.pairs])
        count = np.concatenate([c for _, _, c in self.pairs])
        entry = np.concatenate(self.doc_lang)[doc] * len(order) + term
        placed = np.lexsort((doc, entry))
        entries, sizes = np.unique(entry, return_counts=True)
        terms = encoded.dictionary.take(pa.array(order[entries % max(len(order), 1)]))
        offsets = np.frombuffer(terms.buffers()[1], np.int64)[: len(terms) + 1] if len(terms) else np.zeros(1, np.int64)
        return pa.record_batch(
            {
                "langs": pa.array([list(self.langs)], pa.list_(pa.string())),
                "lang_terms": [packed(np.bincount(entries // max(len(order), 1), minlength=len(self.langs)))],
                "sources": pa.array([list(self.sources)], pa.list_(pa.string())),
                "doc_source": [packed(np.concatenate(self.doc_source))],
                "term_ends": [packed(offsets[1:] - offsets[0])],
                "terms": pa.array([terms.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(terms) and terms.buffers()[2] else b""], pa.binary()),
                "sizes": [packed(sizes)],
                "docs": [packed(doc[placed])],
                "counts": [packed(count[placed])],
            }
        )


def term_blocks(docs: DataFrame) -> DataFrame:
    """The terms of ``docs`` in blocks, one a row."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Gathering()
        for batch in batches:
            for lo, hi, data, bounds in chunks(batch):
                block.add(batch.slice(lo, hi - lo), data, bounds)
                if block.bytes >= BLOCK_BYTES:
                    yield block.block()
                    block = _Gathering()
        if block.n_docs:
            yield block.block()

    return small_batches(docs.select("text", "lang", "source")).mapInArrow(gather, BLOCK)


class _Block:
    """A block read back: terms sorted inside each language, and the documents of each."""

    def __init__(self, row: dict):
        self.langs, self.sources = row["langs"], row["sources"]
        ends = np.concatenate([[0], unpacked(row["term_ends"])])
        self.lengths = np.diff(ends)
        self.terms = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(row["terms"])])
        self.lang = np.repeat(np.arange(len(self.langs)), unpacked(row["lang_terms"]))
        self.sizes, self.docs, self.counts = unpacked(row["sizes"]), unpacked(row["docs"]), unpacked(row["counts"])
        self.doc_source = unpacked(row["doc_source"])

    def names(self, of: list[str], at: np.ndarray) -> pa.Array:
        return pa.array(of, pa.string()).take(pa.array(at))


def _per_block(blocks: DataFrame, schema: str, fn) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield fn(_Block(batch.slice(i, 1).to_pylist()[0]))

    return blocks.mapInArrow(run, schema)


# ----------------------------------------------------------------------------------------------------------- refinement


def extensions(blocks: DataFrame, shorter: int, longer: int) -> DataFrame:
    """Prefixes of ``longer`` bytes, or complete terms, of the terms of more than ``shorter`` bytes, with the block's documents.

    ``parent`` is the prefix of ``shorter`` bytes that they extend.
    """

    def extend(block: _Block) -> pa.RecordBatch:
        at = np.flatnonzero(block.lengths > shorter)
        terms, lang, whole = block.terms.take(pa.array(at)), block.lang[at], block.lengths[at] <= longer
        prefix = pc.binary_slice(terms, 0, longer)
        first = np.ones(len(at), bool)
        if len(at) > 1:
            differ = pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)
            first[1:] = differ | whole[1:] | whole[:-1] | (lang[1:] != lang[:-1])
        group = np.cumsum(first) - 1
        # documents of a group, each once
        of_term = np.full(len(block.lengths), -1, np.int64)
        of_term[at] = group
        of_pair = np.repeat(of_term, block.sizes)
        held = of_pair >= 0
        n_docs = len(block.doc_source)
        pairs = np.unique(of_pair[held] * n_docs + block.docs[held])
        starts = np.flatnonzero(first)
        head = prefix.take(pa.array(starts))
        return pa.record_batch(
            {
                "lang": block.names(block.langs, lang[starts]),
                "parent": pc.binary_slice(head, 0, shorter).cast(pa.binary()),
                "prefix": head.cast(pa.binary()),
                "whole": whole[starts],
                "n_docs": np.bincount(pairs // n_docs, minlength=len(starts)).astype(np.int64) if len(starts) else np.zeros(0, np.int64),
            }
        )

    return _per_block(blocks, "lang string, parent binary, prefix binary, whole boolean, n_docs long", extend)


def kept_terms(blocks: DataFrame, min_docs: int, first: int = FIRST_PREFIX) -> DataFrame:
    """(lang, term) of all terms in at least ``min_docs`` documents of their language; ``term`` is bytes."""
    found, shorter, longer, alive = [], 0, first, None
    while True:
        rows = extensions(blocks, shorter, longer)
        if alive is not None:
            rows = rows.join(alive, ["lang", "parent"], "left_semi")
        counted = rows.groupBy("lang", "prefix", "whole").agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= min_docs)
        level = checkpointed(counted.select("lang", "prefix", "whole"))
        found.append(level.where("whole").select("lang", F.col("prefix").alias("term")))
        alive = level.where("not whole").select("lang", F.col("prefix").alias("parent"))
        if alive.isEmpty():
            break
        shorter, longer = longer, 2 * longer
    terms = found[0]
    for more in found[1:]:
        terms = terms.unionByName(more)
    return checkpointed(terms)


def term_counts(blocks: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n) of the kept terms, in every source that holds them."""

    def count(block: _Block) -> pa.RecordBatch:
        n_sources = max(len(block.sources), 1)
        keys = np.repeat(np.arange(len(block.sizes)), block.sizes) * n_sources + block.doc_source[block.docs]
        order = np.argsort(keys, kind="stable")
        keys, starts = np.unique(keys[order], return_index=True)
        sums = np.add.reduceat(block.counts[order], starts) if len(starts) else np.zeros(0, np.int64)
        entry = keys // n_sources
        return pa.record_batch(
            {
                "lang": block.names(block.langs, block.lang[entry]),
                "source": block.names(block.sources, keys % n_sources),
                "term": block.terms.take(pa.array(entry)).cast(pa.binary()),
                "n": sums,
            }
        )

    rows = _per_block(blocks, "lang string, source string, term binary, n long", count)
    return rows.join(kept, ["lang", "term"], "left_semi").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


# ----------------------------------------------------------------------------------------------------------- divergence


def usage(count: Column, total: Column, terms: Column, smooth: int, scale: int) -> Column:
    """p, exactly; null where the language keeps no term."""
    wide = "decimal(20,0)"
    share = F.call_function("div", F.lit(scale).cast("decimal(10,0)") * (count + smooth).cast(wide), F.nullif(total + terms * smooth, F.lit(0)).cast(wide))
    return F.lit(1).cast("long") + share


def _distances(used: DataFrame, groups: DataFrame, tile_sources: int, slice_terms: int) -> DataFrame:
    """(lang, a, b, value, seen) by tile and slice: sums over the ``seen`` terms that a source of the tile holds."""
    tile = F.expr(f"no div {tile_sources}")
    slices = F.greatest(F.ceil(F.col("terms") / slice_terms), F.lit(1)).cast("int")
    tiled = lambda df: (
        df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.expr(f"cast((sources - 1) div {tile_sources} as int)"))))
        .withColumn("i", F.least(tile, F.col("_other")).cast("int"))
        .withColumn("j", F.greatest(tile, F.col("_other")).cast("int"))
        .select("lang", "i", "j", "slice", "no", "term", "p")
    )
    held = used.withColumn("slice", F.pmod(F.xxhash64("term"), slices).cast("int"))
    absent = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).withColumn("term", F.lit(None).cast("binary"))
    rows = tiled(held).unionByName(tiled(absent.withColumn("p", F.coalesce("zero", F.lit(0)))))

    def compare(key: tuple, part: pa.Table) -> pa.Table:
        _, i, j, _ = [k.as_py() for k in key]
        no, p = part.column("no").to_numpy(), part.column("p").to_numpy()
        encoded = part.column("term").combine_chunks().dictionary_encode()
        term = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        base = np.flatnonzero(term < 0)
        base = base[np.argsort(no[base])]
        sources, zero = no[base], p[base]
        table = np.tile(zero, (len(encoded.dictionary), 1))
        given = np.flatnonzero(term >= 0)
        table[term[given], np.searchsorted(sources, no[given])] = p[given]
        left, right = np.flatnonzero(sources // tile_sources == i), np.flatnonzero(sources // tile_sources == j)
        sums = np.stack([np.abs(table[:, right] - table[:, a : a + 1]).sum(axis=0) for a in left]).astype(np.int64)
        a, b, value = np.repeat(sources[left], len(right)), np.tile(sources[right], len(left)), sums.reshape(-1)
        if i != j:
            a, b, value = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([value, value])
        apart = a != b
        n = int(apart.sum())
        return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "a": a[apart], "b": b[apart], "value": value[apart], "seen": np.full(n, len(table), np.int64)})

    return rows.groupBy("lang", "i", "j", "slice").applyInArrow(compare, "lang string, a long, b long, value long, seen long")


def audit(
    docs: DataFrame, min_docs: int = 30, top: int = 50, smooth: int = 5, scale: int = 1_000_000_000, first_prefix: int = FIRST_PREFIX,
    tile_sources: int = TILE_SOURCES, slice_terms: int = SLICE_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language, part ``pair`` holds the distance to each other source,
    and part ``term`` the ``top`` terms it uses more than the language does; largest first, ties by item."""
    blocks = checkpointed(term_blocks(docs))
    kept = kept_terms(blocks, min_docs, first_prefix)
    counts = checkpointed(term_counts(blocks, kept))

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    occurring = docs.select(name("lang"), name("source")).distinct()
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = occurring.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "terms"])
    by_lang = Window.partitionBy("lang")
    groups = checkpointed(
        groups.select(
            "lang", "source", "total", "terms", usage(zero, F.col("total"), F.col("terms"), smooth, scale).alias("zero"),
            (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long").alias("no"), F.count("*").over(by_lang).alias("sources"),
            F.sum("total").over(by_lang).alias("lang_total"),
        )
    )
    used = counts.join(groups, ["lang", "source"]).withColumn("p", usage(F.col("n"), F.col("total"), F.col("terms"), smooth, scale))

    summed = _distances(used, groups, tile_sources, slice_terms).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    left = groups.select("lang", F.col("no").alias("a"), "source", "terms", F.col("zero").alias("_a"))
    right = groups.select("lang", F.col("no").alias("b"), F.col("source").alias("item"), F.col("zero").alias("_b"))
    unseen = (F.col("terms") - F.col("seen")) * F.abs(F.col("_a") - F.col("_b"))
    pairs = summed.join(left, ["lang", "a"]).join(right, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + F.coalesce(unseen, zero)).alias("value"))

    overall = checkpointed(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")))
    more = used.join(overall, ["lang", "term"]).withColumn("value", F.col("p") - usage(F.col("lang_n"), F.col("lang_total"), F.col("terms"), smooth, scale))
    above = more.where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(first).select("lang", "source", "part", "item", "value", "rank")
