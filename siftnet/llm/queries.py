"""One query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftnet.llm import ann, decontaminate, divergence, fixity, langid, licenses, neardup, packing, periodic, quality, substrings, token_counts, toxicity
from siftnet.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SUBSTRINGS_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
r AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 50)) AS i FROM h JOIN f ON h.h = f.h AND f.first < h.doc_id),
l AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
k AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(l.gone), 0) AS n_removed,
         CASE WHEN l.gone IS NULL THEN d.w
              ELSE list_transform(list_filter(range(1, len(d.w) + 1), lambda i: NOT list_contains(l.gone, i)), lambda i: d.w[i]) END AS kept
  FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


@query("op2_substring_dedup", SUBSTRINGS_SQL)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, window=50, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op1_inverted_multi_index")
def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 20 = 0", neighbours=20)


LICENSES_SQL = r"""
WITH t(label, notice) AS (VALUES __TEMPLATES__),
t2 AS (SELECT label, string_split(notice, ' ') AS tw FROM t),
t3 AS (SELECT label, list_distinct(tw) AS tw FROM t2),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM d),
p AS (
  SELECT doc_id, w, len(w) AS n_words, label, i FROM w LEFT JOIN LATERAL (
    SELECT CASE WHEN w.w[j - 1] = 'mit' THEN 'mit' WHEN w.w[j - 1] = 'apache' THEN 'apache' ELSE 'gpl' END AS label,
           CASE WHEN w.w[j - 1] IN ('mit', 'apache') THEN j - 2 ELSE j - 3 END AS i
    FROM (SELECT unnest(range(2, len(w.w) + 1)) AS j)
    WHERE w.w[j] = 'license' AND (w.w[j - 1] IN ('mit', 'apache') OR (w.w[j - 1] = 'public' AND j > 2 AND w.w[j - 2] = 'general'))) ON true),
b AS (
  SELECT doc_id, any_value(n_words) AS n_words, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM p GROUP BY doc_id),
l AS (SELECT doc_id, n, list_distinct(string_split_regex(line, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS lw
      FROM (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(lower(text), chr(10)), 1) AS n FROM d)
      WHERE regexp_matches(line, 'licen|permitted|mozilla|copyright')),
m AS (SELECT doc_id, n, label, len(list_intersect(tw, lw)) AS common, len(tw) AS size FROM l, t3),
g AS (SELECT * FROM m WHERE common * 100 >= size * 90 QUALIFY common = max(common) OVER (PARTITION BY doc_id, n)),
x AS (SELECT doc_id, label, CAST(common AS DOUBLE) / size AS share FROM g
      UNION ALL SELECT doc_id, label, 1.0 FROM p WHERE label IS NOT NULL),
y AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM x GROUP BY doc_id)
SELECT b.doc_id, b.n_words, b.n_base, b.first_word, b.last_word, b.base_labels, coalesce(y.labels, '') AS labels, coalesce(y.score, 0.0) AS score
FROM b LEFT JOIN y USING (doc_id)
""".replace("__TEMPLATES__", ", ".join(f"('{label}', '{notice}')" for label, notice in licenses.TEMPLATES.items()))


@query("op3_license_scan", LICENSES_SQL)
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def archives(pages: DataFrame) -> DataFrame:
    """Pages as WARC records of archives of 1,000 pages, at the offsets that they have there: archive, offset, content, page_id."""
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "), size,
        F.lit("\r\n\r\n"), F.coalesce("html", F.lit("")), F.lit("\r\n\r\n"),
    )
    rows = pages.where("page_id IS NOT NULL").select("page_id", "url", record.alias("content"))
    rows = rows.withColumn("archive", F.floor(F.col("page_id") / 1000).cast("long"))
    order = Window.partitionBy("archive").orderBy("page_id", "url", F.sha2("content", 256)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("archive", F.coalesce(F.sum(F.octet_length("content").cast("long")).over(order), F.lit(0)).alias("offset"), "content", "page_id")


ARCHIVES_SQL = r"""
r AS (
  SELECT page_id, url, page_id // 1000 AS archive,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
         || chr(13) || chr(10) || chr(13) || chr(10) AS content
  FROM pages WHERE page_id IS NOT NULL),
o AS (
  SELECT archive, page_id, content, CAST(coalesce(sum(strlen(content)) OVER (
           PARTITION BY archive ORDER BY page_id, url, sha256(content) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r)"""

FIXITY_SQL = f"""
WITH {ARCHIVES_SQL},
a AS (SELECT archive, "offset", content FROM o WHERE page_id % 101 <> 7),
b AS (SELECT archive, "offset", CASE WHEN page_id % 89 = 5 THEN left(content, length(content) - 1) || '#' ELSE content END AS content
      FROM o WHERE page_id % 97 <> 11)
SELECT coalesce(a.archive, b.archive) AS archive, coalesce(a."offset", b."offset") AS "offset",
       CASE WHEN b.content IS NULL THEN 'missing' WHEN a.content IS NULL THEN 'extra' ELSE 'corrupt' END AS kind,
       CAST(strlen(a.content) AS BIGINT) AS length_a, CAST(strlen(b.content) AS BIGINT) AS length_b,
       sha256(a.content) AS digest_a, sha256(b.content) AS digest_b
FROM a FULL JOIN b ON a.archive = b.archive AND a."offset" = b."offset" WHERE a.content IS DISTINCT FROM b.content
"""


@query("op4_merkle_fixity", FIXITY_SQL)
def op4_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archives, against a replica in which pages are corrupt, lost or extra by rule."""
    stored = archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    damaged = F.when(F.col("page_id") % 89 == 5, F.expr("concat(left(content, length(content) - 1), '#')")).otherwise(F.col("content"))
    first = stored.where("page_id % 101 <> 7").drop("page_id")
    second = stored.where("page_id % 97 <> 11").withColumn("content", damaged).drop("page_id")
    return fixity.audit(first, second).select("archive", "offset", "kind", "length_a", "length_b", "digest_a", "digest_b")


@query("op5_language_spans")
def op5_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.items_of(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty on every call, so that a run's cost does not depend on earlier ones."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = f"{shared_folder(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    counted = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), cache, by_words=True, limit=2048)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op8_benchmark_leaks")
def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), free_end=True)


@query("op9_toxic_passages")
def op9_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.toxic_passages(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, md5(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.y, r.root FROM r JOIN l ON r.doc_id = l.x WHERE r.root < l.y),
g AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept FROM d JOIN g USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op10_min_max_dedup", NEAR_SQL)
def op10_min_max_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def with_periods(docs: DataFrame) -> DataFrame:
    """The texts of the query: of documents whose h = crc32(doc_id) is a multiple of 10, the words from place a on repeat the p from there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_w"), F.expr("crc32(cast(doc_id as string)) div 10").alias("_g"))
    n = F.size("_w")
    placed = chosen.withColumn("_a", F.when(n > 0, F.expr("cast(_g % size(_w) as int)")))
    placed = placed.withColumn("_p", F.expr("cast(1 + (size(_w) - _a) div (3 + _g % 8) as int)"))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("_w"), place(i))), " ")
    return placed.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


PERIODS_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
t AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w
    ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM g),
p AS (SELECT doc_id, n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM t),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
c AS (SELECT doc_id, q, min(i) AS lo, count(*) + q AS size FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (
  SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.q < c.q AND o.lo <= c.lo AND o.lo + o.size >= c.lo + c.size)),
f AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(lo, size, q), (-size, lo, q)) AS best,
         string_agg(lo || ',' || size || ',' || q || chr(10), '' ORDER BY lo, q) AS listed FROM r GROUP BY doc_id),
x AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(lo + q, lo + size)) AS i FROM r) GROUP BY doc_id),
k AS (
  SELECT t.doc_id, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(0, n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]) END AS w
  FROM t LEFT JOIN x USING (doc_id))
SELECT k.doc_id, coalesce(n_runs, 0) AS n_runs, best.lo AS start, CAST(best.size AS BIGINT) AS length, best.q AS period,
       CAST(1000 * best.size // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(array_to_string(w, ' ')) AS collapsed_sha256
FROM k LEFT JOIN f USING (doc_id)
"""


@query("op13_periodic_runs", PERIODS_SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.withColumn("_b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_b.start")).alias("start"), F.col("_b.length").alias("length"), (-F.col("_b.period")).alias("period"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return rows.withColumn("exponent_milli", F.expr("1000 * length div period"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, sum(n) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
gt AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
u AS (
  SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT) AS HUGEINT) // CAST(total + 5 * v.v AS HUGEINT) AS p
  FROM gt JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term),
l AS (
  SELECT lang, term, 1 + CAST(1000000000 * CAST(n + 5 AS HUGEINT) AS HUGEINT) // CAST(sum(n) OVER (PARTITION BY lang) + 5 * v AS HUGEINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM u a JOIN u b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT u.lang, u.source, 'term', term, CAST(p - q AS BIGINT) FROM u JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM f QUALIFY part = 'pair' OR rank <= 50
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def _class_counts_sql(text: str) -> str:
    """SQL list of the class sizes of quality.CLASSES: each by what its removal shortens."""
    lefts = [text]
    for pattern in quality.CLASSES.values():
        quoted = pattern.replace("'", "''")
        lefts.append(f"regexp_replace({lefts[-1]}, '{quoted}', '', 'g')")
    sizes = [f"length({left})" for left in lefts]
    return "[" + ", ".join([f"{a} - {b}" for a, b in zip(sizes, sizes[1:])] + [sizes[-1]]) + "]"


def _part_sql(p: str, q: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END)"


QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t,
         {_class_counts_sql("coalesce(text, '')")} AS c FROM documents),
p AS (SELECT r, i, md5(array_to_string(w[i:i + 7], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
u AS (SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY r, h) > 1),
n AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS k FROM u) GROUP BY r),
m AS (
  SELECT d.*, len(w) AS n_words, length(coalesce(text, '')) - c[2] AS word_chars, c[6] AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(t) AS n_terms, list_sum(c) AS total FROM d LEFT JOIN n USING (r)),
lc AS (SELECT lang, [{", ".join(f"sum(c[{i + 1}])" for i in range(len(quality.CLASS_NAMES)))}] AS c, sum(total) AS total FROM m GROUP BY lang),
x AS (SELECT r, lang, unnest(t) AS term FROM m),
lt AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term),
ls AS (SELECT lang, sum(n) AS terms FROM lt GROUP BY lang),
top AS (SELECT lang, term, n / terms AS q FROM lt JOIN ls USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= {quality.COMMON_WORDS}),
xc AS (SELECT r, term, count(*) AS n FROM x GROUP BY r, term),
wb AS (
  SELECT m.r, coalesce(xc.n, 0) / m.n_terms AS p, q FROM m JOIN top ON top.lang = m.lang LEFT JOIN xc ON xc.r = m.r AND xc.term = top.term
  WHERE m.n_terms >= {quality.LEAST_TERMS}),
ws AS (SELECT r, sum({_part_sql("p", "q")}) AS inner_, 1 - sum(p) AS p, greatest(1 - sum(q), 0) AS q FROM wb GROUP BY r),
wd AS (SELECT r, sqrt((inner_ + {_part_sql("p", "q")}) / 2) AS word_distance FROM ws),
cd AS (
  SELECT r, sqrt(sum({_part_sql("p", "q")}) / 2) AS class_distance
  FROM (SELECT r, unnest(m.c) / m.total AS p, unnest(lc.c) / lc.total AS q FROM m JOIN lc USING (lang) WHERE m.total > 0) GROUP BY r),
j AS (
  SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed, coalesce(terms, 0) >= {quality.LEAST_REFERENCE} AS enough
  FROM m LEFT JOIN ls USING (lang) LEFT JOIN cd USING (r) LEFT JOIN wd USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (NOT enough OR coalesce(class_distance, 0) <= {quality.MOST_CLASS_DISTANCE} AND coalesce(word_distance, 0) <= {quality.MOST_WORD_DISTANCE}) AS kept
FROM j
"""


@query("op12_distribution_divergence", QUALITY_SQL)
def op12_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return rows.select("doc_id", *quality.MEASURES, "base_failed", "kept")
