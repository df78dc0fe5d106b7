"""License scans by an exact set-similarity join of text blocks with notice templates. SQL functions only.

A block is a line of a text, taken as the set of its words; it matches a template if it holds at least ``percent`` percent of
the template's words. The join is exact and filters as follows:

* words are ordered by their frequency in all texts, rarest first (only words of templates matter; their counts are one
  aggregation with partial sums);
* prefix: a match needs ``need`` of a template's ``size`` words, so it holds one of the ``size - need + 1`` rarest of them; only blocks
  with such a word are joined, on the word;
* length: a block with fewer than ``need`` template words is left out;
* position: from the place of the shared word in both orders, a pair that cannot reach ``need`` any more is left out.

The remaining pairs are verified on the full sets. A block that matches several templates is labelled with all of
them but those whose shared words are a part of another's (cc-by in a notice of cc-by-sa). The templates are a fixed table of a few rows, which is what is broadcast; texts are never shuffled.

Besides, phrases are counted in the words of whole texts; they give the base labels.

Rows and edge cases: a null text is empty; rows are told apart by (doc_id, text), so repeated rows get equal results and null ids are
no exception; input columns named like the added ones are replaced.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.llm.words import without

#: Words end at ASCII characters that are neither letters nor digits.
WORD_END = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices as they commonly stand in texts, by label.
TEMPLATES = {
    "mit": "released under the mit license",
    "apache": "licensed under the apache license version 2 0",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license",
    "agpl": "licensed under the gnu affero general public license",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc0": "to the extent possible under law the author has waived all copyright and related rights to this work",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
}
PERCENT = 90


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_END), lambda w: w != "")


def _list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def global_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by frequency in all texts, rarest first, ties by the word."""
    counts = (
        docs.select(F.explode(F.split(F.lower("text"), WORD_END)).alias("word"))
        .where(F.col("word").isin(vocabulary))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    seen = {r["word"]: r["n"] for r in counts}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def template_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, label, score): a document's blocks that hold a template, with the share of its words."""
    vocabulary = sorted({w for notice in templates.values() for w in notice.split()})
    ordered = global_order(docs, vocabulary)
    rank = {w: i for i, w in enumerate(ordered)}
    rows = []
    for label, notice in templates.items():
        words = sorted(set(notice.split()), key=rank.get)
        need = -(-len(words) * percent // 100)
        rows += [(w, label, words, need, place) for place, w in enumerate(words[: len(words) - need + 1])]
    prefix = sorted({r[0] for r in rows}, key=rank.get)
    # size: one row per template and prefix word
    index = docs.sparkSession.createDataFrame(rows, "word string, label string, template array<string>, need int, place int")

    blocks = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(F.split(F.lower("text"), "\n")).alias("block"))
    # ordered by the global order, as the first argument is
    held = F.array_intersect(_list(ordered), F.split("block", WORD_END))
    blocks = blocks.where(F.col("block").rlike("(" + "|".join(prefix) + ")")).select("doc_id", "text_key", held.alias("held"))
    shared = blocks.select("doc_id", "text_key", "held", F.explode(F.array_intersect(F.col("held"), _list(prefix))).alias("word"))
    at = F.array_position("held", F.col("word")).cast("int") - 1
    reach = 1 + F.least(F.size("template") - F.col("place") - 1, F.size("held") - at - 1)
    first = F.array_position("held", F.array_intersect("template", "held")[0]) - 1 == at
    pairs = shared.join(F.broadcast(index), "word").where(F.size("held") >= F.col("need")).where(first & (reach >= F.col("need")))
    common = F.size(F.array_intersect("template", "held"))
    matched = pairs.withColumn("common", common).where(F.col("common") >= F.col("need"))
    match = F.struct((F.col("common") / F.size("template")).alias("score"), "label", F.array_intersect("template", "held").alias("words"))
    per_block = matched.select("doc_id", "text_key", "held", match.alias("m")).groupBy("doc_id", "text_key", "held").agg(F.collect_set("m").alias("all"))

    def inside(m: Column, other: Column) -> Column:
        return (F.size(m["words"]) < F.size(other["words"])) & (F.size(F.array_except(m["words"], other["words"])) == 0)

    own = F.filter("all", lambda m: ~F.exists("all", lambda other: inside(m, other)))
    return per_block.select("doc_id", "text_key", F.explode(own).alias("m")).select("doc_id", "text_key", "m.label", "m.score")


def phrase_places(words: Column, phrase: str) -> Column:
    """Numbers of the words at which the phrase starts."""
    parts = phrase.split()
    fits = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(parts)])
    numbers = F.when(F.size(words) >= len(parts), F.sequence(F.lit(0), F.size(words) - len(parts)))
    return F.filter(F.coalesce(numbers, F.array().cast("array<int>")), fits)


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score (1 for a phrase, else the largest
    share of a template's words in a block, else 0)."""
    docs = without(docs, *ADDED, "text_key")
    filled = docs.withColumn("text", F.coalesce("text", F.lit("")))
    labels = template_matches(filled.select("doc_id", "text"), templates, percent)
    labels = labels.groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("_found"), F.max("score").alias("_share"))

    # only texts with a last word of a phrase are looked through word by word
    last = "|".join(sorted({p.split()[-1] for p in phrases}))
    kept = [c for c in docs.columns if c != "text"]
    counted = filled.select(
        *[F.col(f"`{c}`") for c in kept],
        F.xxhash64("text").alias("text_key"),
        F.size(_words(F.col("text"))).cast("long").alias("n_words"),
        F.when(F.col("text").rlike(f"(?i)({last})"), _words(_lower(F.col("text")))).alias("_words"),
    )
    names = [f"_p{i}" for i in range(len(phrases))]
    empty = F.array().cast("array<int>")
    placed = counted.select(
        *[F.col(f"`{c}`") for c in kept], "text_key", "n_words",
        *[F.when(F.col("_words").isNotNull(), phrase_places(F.col("_words"), p)).otherwise(empty).alias(n) for n, p in zip(names, phrases)],
    )
    places = F.concat(*[F.col(n) for n in names])
    base = F.concat(*[F.when(F.size(n) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for n, label in zip(names, phrases.values())])
    based = placed.withColumns({"_places": places, "_base": base})
    on = based["doc_id"].eqNullSafe(labels["doc_id"]) & (based["text_key"] == labels["text_key"])
    both = based.join(labels, on, "left")
    all_labels = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_found", F.array().cast("array<string>")))))
    return both.select(
        *[based[f"`{c}`"] for c in kept],
        based["n_words"],
        F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )
