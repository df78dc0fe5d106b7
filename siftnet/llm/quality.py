"""Quality rules in SQL functions only: counts over words and lines, and divergence from references of the language.

* Base rules: too few words, or too many words in windows of ``window`` words that the text repeats.
* Divergence: a text's histogram of character classes, and that of its common words, are compared with the language's by
  Jensen-Shannon distance (0: equal, 1: nothing shared). A language's reference is the sum over all its texts: eight classes, and its
  ``COMMON_WORDS`` most frequent terms with one more bin for all others. A text far from its language in either is rejected.
* Guards: short texts differ from any reference by chance, so the distance of common words counts from ``LEAST_TERMS`` terms on,
  and a reference of fewer than ``LEAST_REFERENCE`` terms judges nothing.

Texts never leave their row: words, windows and histograms are arrays inside it. Windows are compared by 64-bit hash inside one
text. What is shuffled are partial counts of terms by language, and one small row per language that Spark sends to all tasks while
its size allows. Very frequent words and hot sources are summed up before the shuffle.

Rows and edge cases: null text has no words and fails; null lang is a language '' of its own; rows with a null or repeated doc_id are
rows like others; an empty table gives no rows; input columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.functions.net import let
from siftnet.llm.words import without
from siftnet.session import checkpointed

#: Bins of the common-word histogram beside that of all other terms.
COMMON_WORDS = 64
#: Longs of the bit mask that sets aside terms that are not common.
MASK_WORDS = 16
#: Fewest terms of a text, and of a language, from which their common words are compared.
LEAST_TERMS, LEAST_REFERENCE = 50, 1000
#: Largest distances of a text that is kept.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.3, 0.7
#: Least words; most repeated words in a hundred; words in a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

SPACES = r"[\x20\x09-\x0D]+"
NO_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Character classes in the order in which they are taken out of a text; what is left at the end is the last class.
CLASSES = {"lower": "[a-z]+", "space": SPACES, "upper": "[A-Z]+", "digit": "[0-9]+", "mark": r"[.,;:!?'\"()-]+", "symbol": r"[#*$%&|<>]+", "ascii": r"[\x00-\x7F]+"}
CLASS_NAMES = [*CLASSES, "other"]
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*MEASURES, "base_failed", "class_distance", "word_distance", "kept")
HELPERS = ("_text", "_words", "_classes", "_terms", "_lang", "_common", "_shares", "_class_shares", "_reference", "_mask")


def with_classes(docs: DataFrame) -> DataFrame:
    """Add ``_classes``: the numbers of characters of each class. Every class is counted by what its removal shortens."""
    rows, left = docs.withColumn("_left0", F.col("_text")), 0
    for pattern in CLASSES.values():
        rows = rows.withColumn(f"_left{left + 1}", F.regexp_replace(f"_left{left}", pattern, ""))
        left += 1
    sizes = [F.length(f"_left{i}") for i in range(left + 1)]
    counts = [a - b for a, b in zip(sizes, sizes[1:])] + [sizes[-1]]
    return rows.withColumn("_classes", F.array(*[c.cast("long") for c in counts])).drop(*[f"_left{i}" for i in range(left + 1)])


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window which the text holds twice or more."""

    def among(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(order: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(order, k)["h"] == e["h"], F.lit(False))
            found = F.filter(order, lambda e, k: same(e, k - 1) | same(e, k + 1))
            return let(F.sort_array(F.transform(found, lambda e: e["i"])), covered)

        def covered(places: Column) -> Column:
            steps = F.transform(places, lambda p, k: F.coalesce(F.least(F.get(places, k + 1) - p, F.lit(window)), F.lit(window)))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

        # in most texts no window comes twice, and then nothing is sorted
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(placed, twice)).otherwise(F.lit(0).cast("long"))

    def joined(hashes: Column, length: int) -> Column:
        """Hashes of windows of ``window`` words, of those of ``length`` words; by doubling, and an overlap for what remains."""
        if length == window:
            return among(hashes)
        step = min(length, window - length)
        longer = F.transform(
            F.slice(hashes, F.lit(1), F.size(hashes) - step), lambda h, i: F.xxhash64(h, F.get(hashes, i + step))
        )
        return let(longer, lambda found: joined(found, length + step))

    return F.when(F.size(words) > window, let(F.transform(words, lambda w: F.xxhash64(w)), lambda found: joined(found, 1))).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of the base rules, and the columns that the divergence is computed from."""
    rows = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    rows = with_classes(rows).withColumn("_words", F.filter(F.split("_text", SPACES), lambda w: w != ""))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    at = {name: F.get("_classes", F.lit(i)) for i, name in enumerate(CLASS_NAMES)}
    return rows.select(
        *docs.columns, "_text", "_classes",
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - at["space"]).cast("long").alias("word_chars"),
        at["symbol"].alias("n_symbols"),
        let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )


def terms(text: Column) -> Column:
    """Runs of letters, lower-cased; all non-ASCII characters count as letters."""
    return F.filter(F.split(F.lower(text), NO_LETTERS), lambda t: t != "")


def language_of(lang: str) -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit(""))


def references(docs: DataFrame, common: int = COMMON_WORDS) -> DataFrame:
    """A row per language: shares of character classes, the most common terms (ties by term) with their shares, and all terms' number."""
    rows = docs.select(language_of("lang").alias("_lang"), F.coalesce("text", F.lit("")).alias("_text"))
    classes = with_classes(rows).groupBy("_lang").agg(*[F.sum(F.get("_classes", F.lit(i))).alias(n) for i, n in enumerate(CLASS_NAMES)])
    total = sum((F.col(n) for n in CLASS_NAMES[1:]), F.col(CLASS_NAMES[0]))
    shares = classes.select("_lang", F.when(total > 0, F.array(*[F.col(n) / total for n in CLASS_NAMES])).alias("_class_shares"))
    counted = checkpointed(rows.select("_lang", F.explode(terms(F.col("_text"))).alias("term")).groupBy("_lang", "term").agg(F.count("*").alias("n")))
    sums = counted.groupBy("_lang").agg(F.sum("n").alias("_reference"))
    order = Window.partitionBy("_lang").orderBy(F.desc("n"), "term")
    most = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= common)
    # at most ``common`` rows of a language
    listed = most.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("rank", "term", "n"))).alias("l")).join(sums, "_lang")
    common_words = listed.select(
        "_lang", "_reference", F.col("l.term").alias("_common"), F.transform("l.n", lambda n: n / F.col("_reference")).alias("_shares")
    )
    return shares.join(common_words.withColumn("_mask", bit_mask(F.col("_common"))), "_lang", "left")


def _bit(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(64 * MASK_WORDS)).cast("int")


def bit_mask(terms_: Column) -> Column:
    """A set of terms as bits: most other terms are told apart by one look."""
    bits = F.transform(terms_, _bit)
    word = lambda k: F.aggregate(
        F.filter(bits, lambda b: F.shiftright(b, 6) == k), F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63))))
    )
    return F.transform(F.sequence(F.lit(0), F.lit(MASK_WORDS - 1)), word)


def _in_mask(term: Column, mask: Column) -> Column:
    return let(_bit(term), lambda b: F.call_function("shiftright", F.get(mask, F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1)


def _part(p: Column, q: Column) -> Column:
    """A bin's part in twice the divergence."""
    half = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / half)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / half)).otherwise(0.0)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def distance(twice: Column) -> Column:
    """Jensen-Shannon distance, of base 2, from twice the divergence."""
    return F.sqrt(F.least(F.greatest(twice / 2, F.lit(0.0)), F.lit(1.0)))


def class_distance(counts: Column, shares: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda sum_, n: sum_ + n)
    return F.when(total > 0, distance(_sum(F.zip_with(counts, shares, lambda n, q: _part(n / total, q)))))


def word_distance(found: Column, common: Column, shares: Column, mask: Column) -> Column:
    """Distance of the common words among the terms ``found``; all other terms share a bin."""
    n = F.size(found).cast("double")

    def among(codes: Column) -> Column:
        size = F.size(codes)
        firsts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(codes, i) != F.get(codes, i - 1)))

        def bins(starts: Column) -> Column:
            held = F.transform(
                starts,
                lambda i, k: F.struct(
                    ((F.coalesce(F.get(starts, k + 1), size) - i) / n).alias("p"), F.get(shares, (F.get(codes, i) - 1).cast("int")).alias("q")
                ),
            )
            return let(held, lambda b: _sum(F.transform(b, lambda e: _part(e["p"], e["q"]))) - _sum(F.transform(b, lambda e: e["q"])))

        # a common word that the text lacks adds its whole share
        all_shares = _sum(shares)
        present = F.when(size > 0, let(firsts, bins)).otherwise(0.0)
        return distance(present + all_shares + _part((n - size) / n, F.greatest(1 - all_shares, F.lit(0.0))))

    likely = F.filter(found, lambda t: _in_mask(t, mask))
    places = F.filter(F.transform(likely, lambda t: F.array_position(common, t)), lambda c: c > 0)
    return F.when(n > 0, let(F.sort_array(places), among))


def judged(
    docs: DataFrame, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED, common: int = COMMON_WORDS,
    most_class_distance: float = MOST_CLASS_DISTANCE, most_word_distance: float = MOST_WORD_DISTANCE,
    least_terms: int = LEAST_TERMS, least_reference: int = LEAST_REFERENCE,
) -> DataFrame:
    """``docs`` (doc_id, text, lang) with the measures, ``base_failed``, both distances (null where a guard applies) and ``kept``."""
    docs = without(docs, *ADDED, *HELPERS)
    known = checkpointed(references(docs, common))
    rows = measured(docs).withColumn("_lang", language_of("lang")).join(known, "_lang", "left")
    enough = F.coalesce(F.col("_reference") >= least_reference, F.lit(False))
    apart = F.when(enough, class_distance(F.col("_classes"), F.col("_class_shares")))
    of_words = let(
        terms(F.col("_text")), lambda found: F.when(F.size(found) >= least_terms, word_distance(found, F.col("_common"), F.col("_shares"), F.col("_mask")))
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    rows = rows.select(
        *docs.columns, *MEASURES, failed.alias("base_failed"), apart.alias("class_distance"), F.when(enough & ~failed, of_words).alias("word_distance")
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= most_class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= most_word_distance)
    return rows.withColumn("kept", ~F.col("base_failed") & near)
