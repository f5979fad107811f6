"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Measures of every document are plain column expressions. A sketch of each measure is kept per
language and source: counts of rows in logarithmic buckets, whose quantiles are right within 1 %
of the value. Such sketches merge by adding counts, so those of a language and of all documents
come from the groups' without reading rows again, and equal input gives equal fences.

A document is rejected if a measure lies outside its group's fence. Each sketch draws a fence in
the middle of the first gap beyond the median: the first value more than twice as far from the
median as the one before, and more than the measure's ``grain`` away (differences below it are no
gap). Where no gap follows, it lies twice as far out as the last value. Values held by fewer than
one in ``RARE`` rows don't count, so that a few rows can't bridge a gap in a large group. ``WIDTH``
times the spread (distances to the 10 % and 75 % quantiles, ``grain`` at least) bounds it where junk
runs on from clean rows without a gap. So junk of up to just under half a group doesn't move its
fence, and a source whose pages are all full of symbols gets a wide one.

The fence of a group is the mean of its own and its parent's (source, language, all documents),
its own weighing as much as its rows and the parent's as much as ``PARENT_ROWS`` rows: a verdict
doesn't turn on a group reaching some size. Only DataFrame operations are used.

Base rules come first: fewer than 50 words, or over half of them in repeated three-word windows.

Defined results: null and empty texts have no words and fail the base rules; null language or
source is a group of its own; ties and repeated rows get equal results; extra columns stay, and
only the names beginning with ``q_`` must be free; an empty table gives no rows. Three-word
windows are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import WHITE, let, spread_join, written

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50
GROWTH = 1.02  # from one bucket to the next
PARENT_ROWS = 30
WIDTH, RARE = 5.0, 2000
#: Measure: grain (differences below it are no gap), and whether low values are outliers too.
MEASURES = {
    "q_symbols": (0.02, False),  # symbols per character in words
    "q_upper": (0.05, False),  # share of words without lower-case letters
    "q_dup_lines": (0.2, False),  # share of lines that repeat an earlier one
    "q_repeats": (0.15, False),  # share of words in repeated windows
    "q_word_length": (1.0, True),  # characters per word
}


def words(text: Column) -> Column:
    """Runs without white space."""
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[ \t-\r]+", -1))


def repeated_words(word: Column, n: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    at = lambda i: F.get(word, i)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, i, x: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        twice = let(ordered, lambda s: F.transform(F.filter(s, lambda x, i: same(s, i - 1, x) | same(s, i + 1, x)), lambda x: x["i"]))
        # Windows of three cover three words each, less where the next one begins sooner.
        return let(
            F.sort_array(twice),
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(x - F.get(p, i - 1), F.lit(3)))), F.lit(0), lambda a, x: a + x
            ),
        )

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < 3, F.lit(0)).otherwise(counted).cast("long")


def measures(text: Column) -> Column:
    """Struct of all counts of a text."""
    text = F.coalesce(text, F.lit(""))
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")

    def of_words(w: Column) -> Column:
        n = F.size(w)
        upper = F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_words(w, n).alias("n_repeat_words"),
            F.size(upper).cast("long").alias("n_upper"),
        )

    counted = let(words(text), of_words)
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.octet_length(text) - F.octet_length(plain)).cast("long")
    return F.struct(counted.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols"))


def measured(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with their counts and measures, written once."""
    rows = docs.withColumn("q", measures(F.col(text_column)))
    counts = {
        "q_n_words": "q.w.n_words", "q_word_chars": "q.w.word_chars", "q_n_symbols": "q.n_symbols", "q_n_dup_lines": "q.l.n_dup_lines",
        "q_n_repeat_words": "q.w.n_repeat_words", "q_n_upper": "q.w.n_upper", "q_n_lines": "q.l.n_lines",
    }
    return written(rows.select(*docs.columns, *(F.col(path).alias(name) for name, path in counts.items())))


def with_measures(rows: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return rows.withColumns({
        "q_base_failed": (F.col("q_n_words") < LEAST_WORDS) | (100 * F.col("q_n_repeat_words") > REPEAT_PERCENT * F.col("q_n_words")),
        "q_symbols": ratio("q_n_symbols", "q_word_chars"),
        "q_upper": ratio("q_n_upper", "q_n_words"),
        "q_dup_lines": ratio("q_n_dup_lines", "q_n_lines"),
        "q_repeats": ratio("q_n_repeat_words", "q_n_words"),
        "q_word_length": ratio("q_word_chars", "q_n_words"),
    })


def group_key(groups: list[str]) -> Column:
    """One value for each combination of the group columns, nulls included."""
    return F.to_json(F.array(*(F.col(g).cast("string") for g in groups)).cast("array<string>"))


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, measure, value, n``: rows that pass the base rules, counted by bucket; ``value`` is the middle of the bucket.

    A group has at most some 1,100 buckets per measure (ratios from 2**-31 to 1), counted before
    the shuffle, so a group with a third of all rows is no hot spot.
    """
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in MEASURES))).alias("q_m")
    bucket = F.when(F.col("q_m.x") > 0, F.floor(F.log("q_m.x") / F.log(F.lit(GROWTH))))  # null holds zero
    counted = rows.filter(~F.col("q_base_failed")).select(*keys, each).groupBy(*keys, F.col("q_m.measure").alias("measure"), bucket.alias("bucket"))
    value = F.coalesce(F.pow(F.lit(GROWTH), F.col("bucket") + 0.5), F.lit(0.0))
    return counted.agg(F.count("*").alias("n")).select(*keys, "measure", value.alias("value"), "n")


def fences(sketch: DataFrame, key: str) -> DataFrame:
    """``key, n`` and ``<measure>_low``, ``<measure>_high`` of every key of ``sketch``."""
    merged = sketch.groupBy(key, "measure", "value").agg(F.sum("n").alias("n"))
    each = merged.groupBy(key, "measure").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("value", "n"))).alias("held"))  # one entry a bucket
    grain = reduce(lambda c, m: c.when(F.col("measure") == m, F.lit(MEASURES[m][0])), MEASURES, F)

    def at(share: float) -> Column:
        def add(state: Column, x: Column) -> Column:
            upto = state["upto"] + x["n"]
            return F.struct(upto.alias("upto"), F.coalesce(state["value"], F.when(upto >= share * F.col("n"), x["value"])).alias("value"))

        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("value"))
        return F.aggregate("held", start, add, lambda s: s["value"])

    quantiles = each.withColumns({"middle": at(0.5), "lower": at(0.1), "upper": at(0.75)})
    spread = F.greatest(F.col("upper") - F.col("middle"), F.col("middle") - F.col("lower"), grain)

    def distance(away: Column) -> Column:
        """From the median to the fence, by the distances of all values on one side, in order."""
        steps = F.transform(away, lambda x, i: F.struct(x.alias("to"), F.coalesce(F.get(away, i - 1), F.lit(0.0)).alias("from")))
        gap = F.get(F.filter(steps, lambda s: s["to"] > F.greatest(grain, 2 * s["from"])), F.lit(0))
        farthest = F.greatest(grain, F.coalesce(F.array_max(away), F.lit(0.0)))
        return F.least(F.coalesce((gap["from"] + gap["to"]) / 2, 2 * farthest), WIDTH * spread)

    often = F.filter("held", lambda x: x["n"] * RARE >= F.col("n"))
    away = lambda sign: F.sort_array(F.filter(F.transform(often, lambda x: sign * (x["value"] - F.col("middle"))), lambda d: d > 0))
    drawn = quantiles.select(key, "measure", "n", (F.col("middle") + let(away(1), distance)).alias("high"), (F.col("middle") - let(away(-1), distance)).alias("low"))
    of = lambda m, side: F.max(F.when(F.col("measure") == m, F.col(side)))
    low = lambda m: of(m, "low") if MEASURES[m][1] else F.lit(None).cast("double")
    return drawn.groupBy(key).agg(F.max("n").alias("n"), *(of(m, "high").alias(f"{m}_high") for m in MEASURES), *(low(m).alias(f"{m}_low") for m in MEASURES))


def thresholds(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Per group: ``q_key``, its number of rows ``q_rows`` and for each measure the fence ``<measure>_low``, ``<measure>_high``.

    The parents of a group are those of the first ``groups``, one less each time, down to all
    documents. Null fences, which reject nothing, if no document passes the base rules.
    """
    keys = {f"q_key{i}": group_key(groups[:i]) for i in range(len(groups) + 1)}
    rows = rows.withColumns(keys)
    sketch = written(sketches(rows, list(keys)))
    sides = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    result = rows.groupBy(*keys).agg(F.count("*").alias("q_rows"))
    for i, key in enumerate(keys):
        named = fences(sketch, key).select(key, F.col("n").alias("q_n"), *(F.col(s).alias(f"q_own_{s}") for s in sides))
        result = result.join(named if i else F.broadcast(named), key, "left")  # the first has one row
        own = F.col("q_n") / (F.col("q_n") + PARENT_ROWS)
        blend = lambda s: own * F.col(f"q_own_{s}") + (1 - own) * F.col(s)
        result = result.withColumns({s: F.coalesce(blend(s), F.col(s)) if i else F.col(f"q_own_{s}") for s in sides}).drop("q_n", *(f"q_own_{s}" for s in sides))
    return written(result.select(F.col(list(keys)[-1]).alias("q_key"), "q_rows", *sides))


def judged(docs: DataFrame, groups: tuple[str, ...] = ("lang", "source"), text_column: str = "text") -> DataFrame:
    """``docs`` with their counts (``q_n_...``), ``q_base_failed`` and ``q_kept``."""
    rows = with_measures(measured(docs, text_column)).withColumn("q_key", group_key(list(groups)))
    joined = spread_join(rows, thresholds(rows, list(groups)), "q_key", "q_rows", "inner")
    outside = lambda m: F.coalesce((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")), F.col(m) > F.col(f"{m}_high"), F.lit(False))
    kept = reduce(lambda a, b: a & b, (~outside(m) for m in MEASURES), ~F.col("q_base_failed"))
    return joined.withColumn("q_kept", kept)


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    return judged(docs, **options).filter("q_kept").select(*docs.columns)
