"""Near-duplicate groups by min-max hashing, banding and exact verification.

* Every permutation gives two signature values, the minimum and the maximum of the permuted shingle hashes, so 48 hash passes
  make 96 values. Bands of four values put documents with a Jaccard similarity of 0.8 into a common bucket with a probability
  of 1 - (1 - 0.8**4)**24 > 0.999995.
* Documents with equal shingle sets are one node; only nodes enter buckets. Copies, however many, cost one row each.
* Nodes that share buckets, directly or through others, are a family. All candidate pairs lie inside families, so each node's set
  is sent once, to its family, where links are confirmed on the full sets by integers: 100 * common >= percent * union. Only a
  component per node comes out, never pairs.
* A family of more than ``FAMILY_SHINGLES`` shingles is never gathered in a task. There each member is compared with the hubs of its
  buckets; verified links form components. Where a bucket still holds several, new hubs are tried as long as that is cheaper,
  and at last every member outside its bucket's largest component is compared with the members of other components. Two
  members of one bucket are left uncompared only if they are connected already, so no component is missed.

Rows and edge cases: texts that are null or without words have an empty set and link with nothing; fewer words than a shingle
make the whole sequence one shingle; rows with a null doc_id link with nothing, have a null component and are kept; rows that
share a doc_id are one document and may differ in n_shingles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftnet.llm.components import components
from siftnet.llm.words import long_ids, mix, per_chunk, run_hashes, signed, small_batches, split
from siftnet.session import checkpointed

#: Rows of four values; 24 bands need 48 permutations.
BAND_ROWS, BANDS = 4, 24
#: Most shingles of a family that one task takes: 16 MB of hashes.
FAMILY_SHINGLES = 2_000_000
#: In larger families: comparisons per bucket row that the last, exact step may take before another round of hubs is tried first.
CROSS_FACTOR, HUB_ROUNDS = 4, 6


def shingle_sets(data: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within a text, and the number of each text's first one."""
    words = split(data, bounds, lower=True)
    values = words.hashes(0)
    ends = np.repeat(words.firsts[1:], words.counts)
    firsts = np.repeat(words.firsts[:-1], words.counts)
    at = np.arange(len(values))
    starts = at[(at + shingle <= ends) | ((at == firsts) & (ends - firsts < shingle))]
    hashes = run_hashes(values, starts, np.minimum(starts + shingle, ends[starts] if len(starts) else starts))
    owner = words.owner()[starts] if len(starts) else starts
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(bounds)))


def min_max(hashes: np.ndarray, firsts: np.ndarray, permutations: int) -> np.ndarray:
    """A row per text with a shingle: minimum and maximum under each permutation, side by side."""
    seeds = mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64))
    some = firsts[:-1][np.diff(firsts) > 0]
    out = np.empty((len(some), 2 * permutations), np.uint64)
    for k in range(permutations):
        permuted = (hashes ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))
        permuted ^= permuted >> np.uint64(32)
        permuted *= np.uint64(0x9E3779B97F4A7C15)
        out[:, 2 * k] = np.minimum.reduceat(permuted, some)
        out[:, 2 * k + 1] = np.maximum.reduceat(permuted, some)
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for value in signature[:, b * rows : (b + 1) * rows].T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + value)
        out[:, b] = h
    return out


def signatures(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n, a, b, bands): set size, 128-bit hash of the set, and the band hashes."""

    def sign(batch, data, bounds):
        hashes, firsts = shingle_sets(data, bounds, shingle)
        counts = np.diff(firsts)
        some = np.flatnonzero(counts)
        a, b = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
        parts = np.zeros((0, bands), np.uint64)
        if len(some):
            at = firsts[:-1][some]
            a[some] = np.add.reduceat(mix(hashes), at)
            b[some] = np.add.reduceat(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), at)
            parts = band_hashes(min_max(hashes, firsts, bands * rows // 2), bands, rows)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum((counts > 0) * bands)]).astype(np.int32)), pa.array(signed(parts.ravel()))
        )
        return pa.record_batch({"doc_id": batch.column("doc_id"), "n": counts.astype(np.int64), "a": signed(a), "b": signed(b), "bands": lists})

    return per_chunk(docs.select("doc_id", "text"), "doc_id long, n long, a long, b long, bands array<long>", sign)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def pack(batch, data, bounds):
        hashes, firsts = shingle_sets(data, bounds, shingle)
        packed = [hashes[lo:hi].tobytes() for lo, hi in zip(firsts[:-1], firsts[1:])]
        columns = {name: batch.column(name) for name in ("family", "shingles")}
        return pa.record_batch({"node": batch.column("doc_id"), "items": pa.array(packed, pa.binary())} | columns)

    return per_chunk(docs, "node long, items binary, family long, shingles long", pack)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the (a, b) pairs whose full sets are similar enough."""

    def confirm(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                common = int((y[at] == x).sum()) if len(x) else 0
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("right"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return small_batches(rows).mapInArrow(confirm, "a long, b long").distinct()


def _similar_size(percent: int):
    return F.col("n") * 100 >= F.col("n2") * percent, F.col("n2") * 100 >= F.col("n") * percent


def link_family(sets: list[np.ndarray], percent: int, names: np.ndarray) -> np.ndarray:
    """For each of the sets (ascending hashes) the smallest number of a set that it is linked with, over any number of links.

    Sets of one name (ascending), the versions of a document, are linked from the start.
    """
    sizes = np.array([len(x) for x in sets])
    values, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    ends = np.repeat(np.append(starts[1:], len(values)), np.diff(np.append(starts, len(values))))
    # places of each set's shingles in the posting lists; the later sets of a list follow in it
    place = np.argsort(of, kind="stable")
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    root = np.searchsorted(names, names)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(sets)):
        mine = place[firsts[i] : firsts[i + 1]]
        many = ends[mine] - mine - 1
        mine, many = mine[many > 0], many[many > 0]
        if not len(mine):
            continue
        at = np.repeat(mine + 1 - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(of[at], minlength=len(sets))
        later = np.flatnonzero(common)
        for j in later[100 * common[later] >= percent * (sizes[i] + sizes[later] - common[later])].tolist():
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(len(sets))])


def _families(members: DataFrame) -> DataFrame:
    """(node, family, shingles): nodes that share a bucket with another one, and their family's size."""
    hubs = members.groupBy("band").agg(F.min("node").alias("hub"))
    stars = members.join(hubs, "band").select(F.col("hub").alias("a"), F.col("node").alias("b")).where("a < b").distinct()
    family = components(stars).select("node", F.col("component").alias("family"))
    nodes = members.groupBy("node").agg(F.max("n").alias("n")).join(family, "node", "left")
    nodes = nodes.withColumn("family", F.coalesce("family", "node"))
    sizes = nodes.groupBy("family").agg(F.sum("n").alias("shingles"))
    return checkpointed(nodes.join(sizes, "family").select("node", "family", "shingles"))


def _in_families(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of sets with their family."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable")
        nodes = rows["node"].to_numpy()
        smallest = link_family([np.frombuffer(x, np.uint64) for x in rows["items"]], percent, nodes)
        return pd.DataFrame({"node": nodes, "component": nodes[smallest]})

    return sets.groupBy("family").applyInPandas(link, "node long, component long").where("node <> component").distinct()


def _by_hubs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of families of any size."""
    tested, links, found = None, None, None
    for turn in range(HUB_ROUNDS + 1):
        if found is None:
            placed = members.withColumn("c", F.col("node"))
        else:
            placed = members.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        sizes = placed.groupBy("band", "c").agg(F.count("*").alias("size"))
        open_bands = (
            sizes.groupBy("band")
            .agg(F.sum("size").alias("total"), F.max(F.struct("size", "c")).alias("most"), F.count("*").alias("parts"))
            .where("parts > 1")
            .select("band", "total", F.col("most.c").alias("main"), F.col("most.size").alias("main_size"))
        )
        last = turn == HUB_ROUNDS
        if turn:
            open_bands = checkpointed(open_bands)
            work, rows_ = open_bands.agg(F.sum(F.expr("(total - main_size) * total")), F.sum("total")).first()
            if not work:
                break
            last = last or work <= CROSS_FACTOR * rows_ + 100_000
        live = placed.join(open_bands, "band")
        if last:
            minor = live.where("c <> main").select("band", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("c").alias("c2"))
            met = live.join(minor, "band").where((F.col("c") != F.col("c2")))
        else:
            order = F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", "c") if turn else F.struct("node", "n", "c")
            hub = live.groupBy("band").agg(F.min(order).alias("hub"))
            hub = hub.select("band", F.col("hub.node").alias("node2"), F.col("hub.n").alias("n2"), F.col("hub.c").alias("c2"))
            met = live.join(hub, "band").where(F.col("c") != F.col("c2"))
        near, near2 = _similar_size(percent)
        pairs = met.where(near & near2).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = checkpointed(pairs)
        fresh = checkpointed(_linked(pairs, sets, percent))
        tested = pairs if tested is None else tested.union(pairs)
        links = fresh if links is None else links.union(fresh)
        found = components(links)
        if last:
            break
    return found


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs`` (columns doc_id and text)."""
    docs = long_ids(docs.select("doc_id", "text"))
    signed_docs = checkpointed(signatures(docs, shingle, bands, rows))
    filled = signed_docs.where("n > 0 AND doc_id IS NOT NULL")
    classes = checkpointed(filled.groupBy("a", "b", "n").agg(F.min("doc_id").alias("node")))
    nodes = filled.join(classes, ["a", "b", "n"]).where("doc_id = node").select("node", "n", "bands")

    in_band = nodes.select("node", "n", F.explode("bands").alias("band")).distinct()
    shared = in_band.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = checkpointed(in_band.join(shared.select("band"), "band"))
    families = _families(members)

    # families grow with the documents, so they are never broadcast, however few there are
    placed = families.withColumnRenamed("node", "doc_id").hint("merge")
    sets = _sets(docs.where("doc_id IS NOT NULL").join(placed, "doc_id"), shingle)
    found = checkpointed(_in_families(sets.where(F.col("shingles") <= FAMILY_SHINGLES), percent))
    large = families.where(F.col("shingles") > FAMILY_SHINGLES).select("node")
    if not large.isEmpty():
        found = found.union(_by_hubs(members.join(large, "node", "left_semi"), checkpointed(sets.join(large, "node", "left_semi")), percent))

    node_of = signed_docs.join(classes, ["a", "b", "n"], "left").select("doc_id", "n", "node")
    named = node_of.join(found, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id")
    )
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
