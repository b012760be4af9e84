"""The operators of this package as named queries over whole tables, with SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    hard_negatives,
    licences,
    line_dedup,
    neighbours,
    packing,
    quality_rules,
    ranked_search,
    sharding,
    simhash,
    token_counts,
    toxicity,
    url_filters,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def _quality_sql() -> str:
    measures = [f.measure for f in quality_rules.FENCES]
    bins = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS measure, ({m} >> greatest(length(bin({m})) - 6, 0)) "
        f"<< greatest(length(bin({m})) - 6, 0) AS bin FROM m WHERE NOT base_failed"
        for m in measures
    )
    reach = " ".join(
        f"WHEN '{f.measure}' THEN greatest({f.spreads} * least(q50 - q10, q90 - q50), {f.slack}, "
        f"({f.slack_percent} * q50) // 100)"
        for f in quality_rules.FENCES
    )

    def bounds(keys: str) -> str:
        group = f"{keys}, " if keys else ""
        return f"""SELECT {group}measure, any_value(docs) AS docs,
            min(bin) FILTER (100 * upto >= 10 * docs) AS q10, min(bin) FILTER (100 * upto >= 50 * docs) AS q50,
            min(bin) FILTER (100 * upto >= 90 * docs) AS q90 FROM (
            SELECT *, sum(n) OVER (PARTITION BY {group}measure ORDER BY bin) AS upto,
                   sum(n) OVER (PARTITION BY {group}measure) AS docs
            FROM (SELECT {group}measure, bin, count(*) AS n FROM b GROUP BY ALL)) GROUP BY {group}measure"""

    value = " ".join(f"WHEN '{m}' THEN {m}" for m in measures)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
wins AS (SELECT rid, list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' ')) AS a
         FROM w WHERE len(ws) >= 8),
each AS (SELECT rid, unnest(a) AS win, generate_subscripts(a, 1) AS i FROM wins),
seen AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM each),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM seen WHERE c > 1) GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
      CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
m AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
      coalesce((1000 * n_symbols) // nullif(n_words, 0), 0) AS symbols_per_1000_words,
      coalesce((100 * word_chars) // nullif(n_words, 0), 0) AS chars_per_100_words,
      coalesce((1000 * n_dup_lines) // nullif(n_lines, 0), 0) AS dup_lines_per_1000_lines FROM c),
b AS ({bins}),
own AS ({bounds("lang, source")}), by_lang AS ({bounds("lang")}), whole AS ({bounds("")}),
chosen AS (SELECT o.lang, o.source, o.measure,
    CASE WHEN o.docs >= {quality_rules.MIN_DOCS} THEN o.q10 WHEN l.docs >= {quality_rules.MIN_DOCS} THEN l.q10 ELSE w.q10 END AS q10,
    CASE WHEN o.docs >= {quality_rules.MIN_DOCS} THEN o.q50 WHEN l.docs >= {quality_rules.MIN_DOCS} THEN l.q50 ELSE w.q50 END AS q50,
    CASE WHEN o.docs >= {quality_rules.MIN_DOCS} THEN o.q90 WHEN l.docs >= {quality_rules.MIN_DOCS} THEN l.q90 ELSE w.q90 END AS q90
    FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN whole w ON o.measure = w.measure),
fence AS (SELECT lang, source, measure, q50, CASE measure {reach} END AS reach FROM chosen),
verdict AS (SELECT rid, bool_and(abs(CASE measure {value} END - q50) <= reach) AS inside
    FROM m JOIN fence f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(inside, false) AS kept
FROM m LEFT JOIN verdict USING (rid)"""


@query("op1_quality_rules", _quality_sql())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    report = quality_rules.quality_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", *counts, "base_failed", "kept")


@query(
    "op2_line_dedup",
    """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5),
j AS (SELECT rid, k.doc_id, pos, line, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS lost
      FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id""",
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = line_dedup.without_shared_lines(table(spark, sf_dir, "documents"))
    return df.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sharding.sharded(table(spark, sf_dir, "documents"))
    return df.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = simhash.classes(table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licence_sql() -> str:
    def canonical(text: str) -> str:
        out = f"regexp_replace(lower({text}), '(?m)^[ \\t]*(copyright|\\(c\\)|©)[^\\n]*$', '', 'g')"
        out = f"regexp_replace({out}, '[ \\t\\r\\n]+', ' ', 'g')"
        for old, new in licences.SPELLINGS:
            out = f"replace({out}, {_sql_text(old)}, {_sql_text(new)})"
        return f"nullif(trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '')"

    known = ", ".join(
        f"({_sql_text(name)}, '{kind}', {_sql_text(t)})"
        for kind, group in (("text", licences.TEXTS), ("notice", licences.NOTICES))
        for name, all_ in group.items()
        for t in all_
    )
    return f"""
WITH known AS MATERIALIZED (SELECT sha256({canonical("text")}) AS digest, min(license) AS license
               FROM (VALUES {known}) AS v(license, kind, text) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
whole AS (SELECT rid, doc_id, sha256({canonical("text")}) AS text_digest FROM d),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
notes AS (SELECT rid, count(license) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
          FROM (SELECT rid, sha256({canonical("line")}) AS digest FROM lines) JOIN known USING (digest) GROUP BY rid)
SELECT doc_id, text_digest, license AS text_license, coalesce(n, 0) AS n_notices, coalesce(names, '') AS notice_licenses
FROM whole LEFT JOIN notes USING (rid) LEFT JOIN known ON digest = text_digest"""


@query("op5_license_scans", _licence_sql())
def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known_licences(spark))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.section_counts(
        table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


_PAGES_FROM = "2024-01-01"


def _number(key: str) -> Column:
    """A number below 2^32 that depends on a text alone; SQL engines share MD5."""
    return F.conv(F.substring(F.md5(F.expr(key)), 1, 8), 16, 10).cast("long")


def list_history(pages: DataFrame) -> DataFrame:
    """A block list derived from the hosts of the pages: three dated entries for each domain.

    The tables have no list, so entries, days, actions and categories follow from the domain's MD5.
    """
    host = url_filters.host_of(F.col("url"))
    domain = F.regexp_replace(host, r"^(blog|m|www)\.", "")
    names = pages.select(domain.alias("domain")).where("domain is not null").distinct()
    entries = names.withColumn("seq", F.explode(F.array(*map(F.lit, range(3)))))
    entries = entries.withColumn("h", _number("concat(domain, '/', seq)"))
    return entries.select(
        "domain",
        F.date_add(F.lit(_PAGES_FROM).cast("date"), (F.col("h") % 366).cast("int")).alias("day"),
        "seq",
        F.when(F.expr("h div 366") % 3 == 0, "remove").otherwise("add").alias("action"),
        F.element_at(F.array(*map(F.lit, ("spam", "malware", "adult", "mirror"))), (F.expr("h div 1098") % 4 + 1).cast("int")).alias("category"),
    )


@query(
    "op8_url_filters",
    f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, nullif(rtrim(lower(regexp_extract(url,
    '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), '') AS host,
    DATE '{_PAGES_FROM}' + CAST(CAST('0x' || substr(md5(url || '#' || page_id), 1, 8) AS BIGINT) % 366 AS INTEGER) AS fetched_on
    FROM pages),
names AS (SELECT DISTINCT regexp_replace(host, '^(blog|m|www)\\.', '') AS domain FROM p WHERE host IS NOT NULL),
e AS (SELECT domain, seq, CAST('0x' || substr(md5(domain || '/' || seq), 1, 8) AS BIGINT) AS h
      FROM names, (SELECT unnest(range(3)) AS seq)),
l AS (SELECT domain, seq, DATE '{_PAGES_FROM}' + CAST(h % 366 AS INTEGER) AS day,
      CASE WHEN (h // 366) % 3 = 0 THEN 'remove' ELSE 'add' END AS action,
      (['spam', 'malware', 'adult', 'mirror'])[(h // 1098) % 4 + 1] AS category FROM e),
i AS (SELECT *, lead(day) OVER (PARTITION BY domain ORDER BY day, seq) AS until FROM l),
hit AS (SELECT rid, arg_max(domain, length(domain)) AS matched_domain, arg_max(category, length(domain)) AS category,
        arg_max(day, length(domain)) AS listed_from
        FROM p JOIN i ON (host = domain OR ends_with(host, '.' || domain))
        WHERE action = 'add' AND fetched_on >= day AND (until IS NULL OR fetched_on < until) GROUP BY rid)
SELECT page_id, host, fetched_on, matched_domain, category, listed_from, matched_domain IS NOT NULL AS blocked
FROM p LEFT JOIN hit USING (rid)""",
)
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit(_PAGES_FROM).cast("date"), (_number("concat(url, '#', page_id)") % 366).cast("int"))
    captures = pages.withColumn("fetched_on", day)
    df = url_filters.as_of(captures, url_filters.intervals(list_history(pages)))
    return df.select("row.page_id", "host", "row.fetched_on", "matched_domain", "category", "listed_from", "blocked")


@query(
    "op9_decontamination",
    """
WITH norm AS (SELECT 0 AS bench, row_number() OVER () AS rid, doc_id, CAST(NULL AS VARCHAR) AS item_id,
    coalesce(text, '') AS t FROM documents
    UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(CAST(item_id AS VARCHAR), ''), coalesce(text, '') FROM benchmark),
w AS MATERIALIZED (SELECT bench, rid, doc_id, item_id, regexp_extract_all(
    translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM norm),
size AS (SELECT DISTINCT least(len(ws), 13) AS k FROM w WHERE bench = 1 AND len(ws) > 0),
win AS (SELECT item_id, least(len(ws), 13) AS k, unnest(list_transform(range(1, len(ws) - least(len(ws), 13) + 2),
        lambda i: array_to_string(ws[i:i + least(len(ws), 13) - 1], ' '))) AS g FROM w WHERE bench = 1 AND len(ws) > 0),
bw AS MATERIALIZED (SELECT DISTINCT item_id, k, g FROM win),
dw AS (SELECT rid, k, list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' ')) AS gs
       FROM w, size WHERE bench = 0 AND len(ws) >= k),
pos AS (SELECT rid, k, unnest(gs) AS g, generate_subscripts(gs, 1) AS i FROM dw),
hit AS MATERIALIZED (SELECT rid, item_id, k, i FROM pos JOIN bw USING (k, g)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN words USING (rid) LEFT JOIN items USING (rid) WHERE bench = 0""",
)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = decontamination.hits(docs, table(spark, sf_dir, "benchmark"))
    return df.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op11_ranked_search",
    """
WITH terms AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
asked AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM benchmark),
all_ AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM terms WHERE len(ts) > 0),
doc AS (SELECT rid, doc_id, 75 + (25 * len(ts) * n_docs) // n_terms AS m FROM terms, all_ WHERE len(ts) > 0),
tf AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM terms) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), all_),
item AS (SELECT q, item_id, term, count(*) AS qtf FROM (SELECT q, item_id, unnest(ts) AS term FROM asked) GROUP BY ALL),
scored AS (SELECT q, item_id, rid, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
           FROM item JOIN w USING (term) JOIN tf USING (term) JOIN doc USING (rid) GROUP BY ALL),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
           FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20""",
)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_nearest_neighbours")
def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query(
    "op13_hard_negatives",
    """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.rid AS a, a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.c, b.c), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id),
p AS (SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS pr
      FROM s WHERE same QUALIFY pr <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
      CAST(row_number() OVER (PARTITION BY p.a, pr ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = table(spark, sf_dir, "embeddings").withColumn("label", label)
    df = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0)
    return df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
