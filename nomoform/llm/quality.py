"""Quality rules with thresholds learnt from mergeable quantile sketches, in DataFrame functions only.

The sketch is a log-linear histogram: an integer is cut to its six leading
bits, so a cell is within 1/32 of its values, the cells of a group are a few
hundred at most, and two sketches merge by adding counts. Sketches are kept per
language and source and merged up to language and to all documents, which
stand in for groups with too few documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, small_join, words

SYMBOLS = "#*$%&|<>"
#: Metric -> two quantiles of a group's sketch, in hundredths, and how many times their distance the fences lie beyond them.
#: Counts that most texts lack take their spread from a higher quantile than the quartiles, which are 0.
FENCES = {"symbols_pm": (50, 80, 1), "dup_lines_pm": (50, 98, 1), "repeats_pm": (50, 98, 1), "word_len_c": (25, 75, 6)}
MIN_SUPPORT = 50
ANY = "*"


def _repeat_words(ws: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the text."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            pairs,
            lambda p: F.transform(
                F.filter(
                    F.transform(
                        p,
                        lambda x, j: F.struct(
                            x["i"].alias("i"),
                            (
                                ((j > 0) & (F.get(p, j - 1)["h"] == x["h"]))
                                | F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False))
                            ).alias("twice"),
                        ),
                    ),
                    lambda x: x["twice"],
                ),
                lambda x: x["i"],
            ),
        )
        return F.aggregate(
            F.sort_array(starts),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).alias("last")),
            lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(5), i - acc["last"])).cast("long").alias("n"), i.alias("last")
            ),
        )["n"]

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(ws) - 5),
        lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(5)]),
    )
    counted = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")),
    )
    return F.when(F.size(ws) >= 5, counted).otherwise(F.lit(0).cast("long"))


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text; a null text has no words.

    Windows of five words are told apart by a 64-bit hash of the words. lang and
    source are marked by a sign, so that no value is taken for null or ANY.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"),
    ).select("doc_id", "lang", "source", "word_chars", "n_symbols", "l.*", "w.*")


def _cell(value: Column) -> Column:
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def _per(part: str, whole: str, scale: int) -> Column:
    return F.expr(f"CASE WHEN {whole} > 0 THEN {scale} * {part} DIV {whole} ELSE 0L END")


def sketches(metrics: DataFrame) -> DataFrame:
    """lang, source, metric, cell, n: one mergeable sketch per group and metric."""
    sound = metrics.where(~F.col("base_failed"))
    cells = sound.select("lang", "source", *[_cell(F.col(m)).alias(m) for m in FENCES])
    long = cells.unpivot(["lang", "source"], list(FENCES), "metric", "cell")
    return long.groupBy("lang", "source", "metric", "cell").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """Fences per language and source; groups below MIN_SUPPORT use the merged sketch above them.

    A fence lies a multiple of the distance of two of the group's quantiles beyond
    them, and at least one unit, the resolution of a metric; there is no other constant.
    """
    levels = sketch.unionByName(sketch.withColumn("source", F.lit(ANY))).unionByName(
        sketch.withColumn("source", F.lit(ANY)).withColumn("lang", F.lit(ANY))
    )
    merged = levels.groupBy("lang", "source", "metric", "cell").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang", "source", "metric")
    ranked = merged.withColumn("cum", F.sum("n").over(w.orderBy("cell"))).withColumn("total", F.sum("n").over(w))
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for m, p in FENCES.items() for x in (m, p[k])]), F.col("metric"))
    at = lambda k: F.min(F.when(F.col("cum") * 100 >= F.col("total") * of(k), F.col("cell")))
    spread = ranked.groupBy("lang", "source", "metric").agg(F.max("total").alias("total"), at(0).alias("low"), at(1).alias("high"))
    reach = F.greatest(of(2) * (F.col("high") - F.col("low")), F.lit(1))
    fences = spread.select("lang", "source", "metric", "total", (F.col("high") + reach).alias("hi"), (F.col("low") - reach).alias("lo"))

    def side(lang: Column, source: Column, tag: str) -> DataFrame:
        return fences.where(lang & source).select(
            *([] if tag == "a" else ["lang"]), *(["source"] if tag == "g" else []), "metric",
            *[F.col(c).alias(f"{tag}_{c}") for c in ("total", "hi", "lo")],
        )

    yes, star = F.lit(True), F.col("source") == ANY
    group = side(F.col("lang") != ANY, ~star, "g")
    by_lang, by_all = side(F.col("lang") != ANY, star, "l"), side(F.col("lang") == ANY, yes, "a")
    joined = group.join(by_lang, ["lang", "metric"]).join(by_all, ["metric"])
    pick = lambda c: (
        F.when(F.col("g_total") >= MIN_SUPPORT, F.col(f"g_{c}")).when(F.col("l_total") >= MIN_SUPPORT, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    )
    chosen = joined.select("lang", "source", "metric", pick("hi").alias("hi"), pick("lo").alias("lo"))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
    return chosen.groupBy("lang", "source").agg(*[of(m, "hi") for m in FENCES], of("word_len_c", "lo"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, base verdict and adaptive verdict of every document.

    ``docs``: doc_id, text, lang, source; other columns are ignored. A null
    text has no words and fails the base rule; null lang or source form a
    group of their own; repeated rows are judged each; an empty table gives no
    rows. ``kept`` is false for a failed base rule, else true if all metrics
    lie within the fences of the document's language and source.
    """
    counts = base_metrics(docs).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    metrics = cut(
        counts.withColumns(
            {
                "symbols_pm": _per("n_symbols", "n_words", 1000),
                "dup_lines_pm": _per("n_dup_lines", "n_lines", 1000),
                "repeats_pm": _per("n_repeat_words", "n_words", 1000),
                "word_len_c": _per("word_chars", "n_words", 100),
            }
        ),
        "quality-metrics",
    )
    fences = cut(thresholds(sketches(metrics)), "quality-fences")
    judged = small_join(metrics, fences, ["lang", "source"])
    inside = F.lit(True)
    for m in FENCES:
        inside = inside & (F.col(m) <= F.col(f"{m}_hi"))
    inside = inside & (F.col("word_len_c") >= F.col("word_len_c_lo"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
    )
