"""Quality rules whose thresholds come from quantile sketches per language and source.

A sketch is a table of counts: one row per group, measure and bin. Bins keep the
leading six binary digits of an integer measure, so a quantile is off by at most
one part in 32, and sketches merge by adding counts, exactly and in any order. A
group's fences come from its own sketch; a group with few documents uses the merged
sketch of its language, and a language with few documents that of the corpus.

Everything is DataFrame code. The measures are taken once per text inside the scan;
what is shuffled are counts per bin, at most about two thousand per group and task.

Defined cases. A null text has no words. Null language or source is a group of its
own. Fewer than 20 words, or over 30 % of the words in repeated 8-word windows, fail
the base rules and take no part in the sketches. Repeated rows are judged each on its
own, with equal results. An empty table gives an empty result. Columns of the input
other than doc_id, text, lang and source pass through :func:`keep` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, words_of, written

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
LEADING_BITS = 6


@dataclass(frozen=True)
class Fence:
    """Bounds of one measure: median ± ``spreads`` spreads, and at least ``slack`` away.

    The spread is the smaller of the distances from the median to the 10 % and 90 %
    quantiles, so that junk on one side does not widen its own fence.
    """

    measure: str
    spreads: int
    slack: int
    slack_percent: int = 0


#: Documented defaults; the unit is a thousandth of a symbol or line, or a hundredth of a character.
FENCES = (
    Fence("symbols_per_1000_words", 6, 250),
    Fence("chars_per_100_words", 5, 0, 20),
    Fence("dup_lines_per_1000_lines", 6, 500),
)
MIN_DOCS = 100


def _repeat_words(n: Column, windows: Column, pairs: Column) -> Column:
    """Words covered by the windows in ``pairs`` that share their hash with a neighbour.

    ``pairs`` is sorted by hash and position, so equal windows stand side by side.
    """
    twice = F.filter(
        pairs,
        lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def cover(done: Column, i: Column) -> Column:
        end = i + F.lit(WINDOW)
        return F.struct(end.alias("end"), (done["n"] + end - F.greatest(i, done["end"])).alias("n"))

    return F.aggregate(F.sort_array(F.transform(twice, lambda p: p["i"])), start, cover, lambda done: done["n"])


def measured(docs: DataFrame) -> DataFrame:
    """``row`` (the input row) with the base counts and the three integer measures."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    df = docs.select(F.struct("*").alias("row"))
    df = df.select(
        "row",
        words_of(text).alias("words"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{BLANK}]")).alias("lines"),
    )
    n = F.size("words")
    df = df.select(
        "row",
        "n_symbols",
        n.alias("n"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
        ).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn(
        "pairs",
        F.when(
            repeats,
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    n_repeat = F.coalesce(_repeat_words(F.col("n"), F.col("windows"), F.col("pairs")), F.lit(0))
    df = df.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        n_repeat.cast("long").alias("n_repeat_words"),
    )
    per = lambda a, b, unit: F.expr(f"coalesce(({unit} * {a}) div nullif({b}, 0), 0)")
    return df.withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "symbols_per_1000_words": per("n_symbols", "n_words", 1000),
            "chars_per_100_words": per("word_chars", "n_words", 100),
            "dup_lines_per_1000_lines": per("n_dup_lines", "n_lines", 1000),
        }
    )


def bin_of(value: Column) -> Column:
    """Lower end of the sketch bin of a non-negative integer: its leading binary digits."""
    low = F.greatest(F.length(F.bin(value)) - LEADING_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketch(rows: DataFrame, fences=FENCES) -> DataFrame:
    """Counts per (lang, source, measure, bin) of the rows that pass the base rules."""
    each = F.explode(
        F.array(*[F.struct(F.lit(f.measure).alias("measure"), bin_of(F.col(f.measure)).alias("bin")) for f in fences])
    )
    return (
        rows.where(~F.col("base_failed"))
        .select("lang", "source", each.alias("m"))
        .groupBy("lang", "source", "m.measure", "m.bin")
        .agg(F.count("*").alias("n"))
    )


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches added up over all columns but ``keys``."""
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def _bounds(sketches: DataFrame, keys: list[str], fences) -> DataFrame:
    """Fences of each group of ``keys``, with its number of documents."""
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = merged(sketches, *keys).withColumns({"upto": F.sum("n").over(upto), "docs": F.sum("n").over(group)})
    quantile = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("docs"), F.col("bin")))
    df = df.groupBy(*keys, "measure").agg(
        F.first("docs").alias("docs"), quantile(10).alias("q10"), quantile(50).alias("q50"), quantile(90).alias("q90")
    )
    spread = F.least(F.col("q50") - F.col("q10"), F.col("q90") - F.col("q50"))
    reach = F.lit(None).cast("long")
    for f in fences:
        own = F.greatest(spread * f.spreads, F.lit(f.slack), F.expr(f"({f.slack_percent} * q50) div 100"))
        reach = F.when(F.col("measure") == f.measure, own).otherwise(reach)
    df = df.withColumn("reach", reach)
    return df.groupBy(*keys).agg(
        F.min("docs").alias("docs"),
        *[
            F.max(F.when(F.col("measure") == f.measure, F.col("q50") + sign * F.col("reach"))).alias(f"{side}_{f.measure}")
            for f in fences
            for side, sign in (("low", -1), ("high", 1))
        ],
    )


def thresholds(sketches: DataFrame, fences=FENCES, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row of fences per (lang, source), taken from the nearest level with enough documents."""
    names = [f"{side}_{f.measure}" for f in fences for side in ("low", "high")]
    level = lambda df, tag: df.select(
        *[c for c in ("lang", "source") if c in df.columns],
        F.struct("docs", *names).alias(tag),
    )
    own = level(_bounds(sketches, ["lang", "source"], fences), "own")
    lang = level(_bounds(sketches, ["lang"], fences), "by_lang").withColumnRenamed("lang", "l")
    df = own.join(lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    # the corpus level is one row, which stands as constants
    row = _bounds(sketches.withColumn("k", F.lit(0)), ["k"], fences).select("docs", *names).first()
    whole = F.struct(*[F.lit(row[n] if row else None).cast("long").alias(n) for n in ("docs", *names)])
    chosen = (
        F.when(F.col("own.docs") >= min_docs, F.col("own"))
        .when(F.col("by_lang.docs") >= min_docs, F.col("by_lang"))
        .otherwise(whole)
    )
    return df.select("lang", "source", chosen.alias("t")).select("lang", "source", *[f"t.{n}" for n in names])


def judged(rows: DataFrame, bounds: DataFrame, fences=FENCES) -> DataFrame:
    """``rows`` with ``kept``: base rules passed and every measure inside its fences."""
    b = bounds.withColumnsRenamed({"lang": "b_lang", "source": "b_source"})
    same = F.col("lang").eqNullSafe(F.col("b_lang")) & F.col("source").eqNullSafe(F.col("b_source"))
    inside = F.lit(True)
    for f in fences:
        inside &= F.col(f.measure).between(F.col(f"low_{f.measure}"), F.col(f"high_{f.measure}"))
    joined = rows.join(b, same, "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop(*b.columns)


def quality_report(docs: DataFrame, fences=FENCES, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: counts, measures, ``base_failed`` and ``kept``; no text."""
    counts = measured(docs).select("row.doc_id", "row.lang", "row.source", "*").drop("row")
    rows = written(counts, "quality-counts")
    bounds = written(thresholds(written(sketch(rows, fences), "quality-sketch"), fences, min_docs), "quality-bounds")
    return judged(rows, bounds, fences)


def keep(docs: DataFrame, fences=FENCES, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents that pass, with their own columns only.

    Texts and measures are written once and read back, so that no text is measured
    twice and the texts are not shuffled: the table of fences is small and planned
    from its real size.
    """
    rows = written(measured(docs).select("row.lang", "row.source", "*"), "quality-rows")
    bounds = written(thresholds(written(sketch(rows, fences), "quality-sketch"), fences, min_docs), "quality-bounds")
    return judged(rows, bounds, fences).where("kept").select("row.*")
