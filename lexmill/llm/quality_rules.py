"""Quality rules whose thresholds come from the data, in DataFrame operations only.

Each measure of a document is a ratio in millionths. Its quantile sketch is a
histogram over buckets whose borders grow by ``GAMMA``: sketches merge by adding
counts, ranks are exact, and a quantile's value is off by at most ``GAMMA - 1``
of itself. One is kept for each language and source.

Small groups shrink towards larger ones by merging too: a language's sketch
takes in the whole corpus's, scaled to ``PRIOR`` documents, and a group's takes
in its language's, scaled likewise. The threshold of a measure is its upper
quantile in the group's sketch plus a multiple of that quantile's distance from
the median. No threshold is fixed; where nearly all documents have none of a
thing, having any is enough to be rejected, and never can more than the share
above the upper quantile be.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD_PATTERN, written

MIN_WORDS = 50
REPEAT_PERCENT = 50
GAMMA = 1.05
#: Documents that the next larger group counts for in a smaller one's sketch.
PRIOR = 200
GROUPS_BROADCAST = 100_000
#: The upper quantile of each measure, and how many of its distances from the median a document may lie above it.
RULES = {"symbols": (0.90, 10), "repeats": (0.98, 3), "capitals": (0.98, 3), "word_length": (0.98, 3)}
MEASURES = tuple(RULES)


def _repeat_words() -> Column:
    """Words inside 3-word windows that occur twice or more in the array ``words``.

    Windows become 33 bits of hash over 31 bits of place, sorted as plain
    longs; places whose neighbours share the bits are compared by the full
    64-bit hash. No window is compared with all others.
    """
    return F.expr("""
        case when size(words) < 4 then 0 else aggregate(
          transform(
            array(transform(sequence(0, size(words) - 3), i -> (xxhash64(words[i], words[i + 1], words[i + 2]) & -2147483648L) | i)),
            raw -> sort_array(raw)),
          0, (acc, s) -> aggregate(
            transform(
              array(transform(
                filter(sequence(0, size(s) - 1), j -> (j > 0 and shiftright(s[j], 31) = shiftright(s[j - 1], 31)) or (j < size(s) - 1 and shiftright(s[j], 31) = shiftright(s[j + 1], 31))),
                j -> cast(s[j] & 2147483647L as int))),
              at -> sort_array(transform(at, p -> named_struct('h', xxhash64(words[p], words[p + 1], words[p + 2]), 'p', p)))),
            0, (acc2, t) -> aggregate(
              transform(
                array(sort_array(transform(filter(
                  case when size(t) = 0 then array() else sequence(0, size(t) - 1) end,
                  k -> (k > 0 and t[k].h = t[k - 1].h) or (k < size(t) - 1 and t[k].h = t[k + 1].h)), k -> t[k].p))),
                d -> aggregate(d, named_struct('n', 0, 'last', -3), (z, p) -> named_struct('n', z.n + least(3, p - z.last), 'last', p), z -> z.n)),
              0, (x, y) -> x + y))) end""")


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every row's text and the measures in thousandths. ``id_col`` may be any column, also a struct."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = {"lang": F.col("lang"), "source": F.col("source")} if {"lang", "source"} <= set(docs.columns) else {"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}
    x = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(n) for n, c in cols.items()), text.alias("text"))
    x = x.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(WORD_PATTERN))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    x = x.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), count(r"[#*$%&|<>]").alias("n_symbols"),
        lines.alias("lines"), _repeat_words().cast("long").alias("n_repeat_words"), count(r"[A-Z]").alias("n_capitals"),
    )
    x = x.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    part = lambda a, b: F.when(F.col(b) > 0, F.expr(f"1000000 * {a} div {b}")).otherwise(F.lit(0)).cast("long")
    return x.select("*", part("n_symbols", "word_chars").alias("symbols"), part("n_repeat_words", "n_words").alias("repeats"), part("n_capitals", "word_chars").alias("capitals"), part("word_chars", "n_words").alias("word_length"))


def bucket(value: str) -> Column:
    """The sketch's bucket of a measure: 0 for none, else 1 and up."""
    return F.expr(f"case when {value} <= 0 then 0 else 1 + cast(ceil(ln({value}) / ln({GAMMA}D)) as int) end")


def sketch_value(b: str) -> Column:
    """The upper border of a bucket."""
    return F.expr(f"case when {b} = 0 then 0L else cast(floor(pow({GAMMA}D, {b} - 1)) as long) end")


def _fences(x: DataFrame) -> DataFrame:
    """(lang, source, and the fence of each measure) from the merged sketches."""
    long = x.where("not base_failed").select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(m).alias("b")) for m in MEASURES))).alias("e"))
    cells = written(long.groupBy("lang", "source", F.col("e.measure").alias("measure"), F.col("e.b").alias("b")).agg(F.count("*").alias("n")), "cells")

    def spread(small: DataFrame, large: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
        """The cells of ``small`` with those of ``large``, scaled to PRIOR documents, added to each of its groups (``keys``); ``on`` are those that ``large`` has."""
        docs = large.groupBy(*on, "measure").agg(F.sum("n").cast("double").alias("docs"))
        same = lambda a, b: reduce(and_, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in on), F.col(f"{a}.measure") == F.col(f"{b}.measure"))
        scaled = large.alias("a").join(docs.alias("b"), same("a", "b")).select("a.*", (F.col("a.n") * PRIOR / F.col("b.docs")).alias("share"))
        groups = small.select(*keys, "measure").distinct()
        more = groups.alias("a").join(scaled.alias("b"), same("a", "b")).select(*(f"a.{c}" for c in keys), "a.measure", "b.b", F.col("b.share").alias("n"))
        return small.select(*keys, "measure", "b", F.col("n").cast("double").alias("n")).unionByName(more).groupBy(*keys, "measure", "b").agg(F.sum("n").alias("n"))

    by_lang = cells.groupBy("lang", "measure", "b").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("measure", "b").agg(F.sum("n").alias("n"))
    langs = spread(by_lang, overall, ["lang"], [])
    mixed = spread(cells, langs, ["lang", "source"], ["lang"])

    own = Window.partitionBy("lang", "source", "measure")
    run = F.sum("n").over(own.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    h = mixed.withColumn("run", run + F.lit(1e-6)).withColumn("total", F.sum("n").over(own))
    upper = F.element_at(F.create_map(*(F.lit(z) for m, (q, _) in RULES.items() for z in (m, q))), F.col("measure"))
    far = F.element_at(F.create_map(*(F.lit(z) for m, (_, k) in RULES.items() for z in (m, k))), F.col("measure"))
    at = lambda q: F.min(F.when(F.col("run") >= F.col("total") * q, F.col("b")))
    h = h.groupBy("lang", "source", "measure").agg(at(0.5).alias("b50"), at(upper).alias("bup"))
    h = h.withColumn("low", sketch_value("b50")).withColumn("up", sketch_value("bup"))
    fence = F.col("up") + far * (F.col("up") - F.col("low"))
    return h.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, fence)).alias(f"{m}_most") for m in MEASURES))


def _judged(x: DataFrame, f: DataFrame) -> DataFrame:
    """``x`` with its group's fences and the verdict. There is one row of fences a group; past a checked number of them they aren't broadcast."""
    f = written(f, "fences")
    side = F.broadcast(f) if f.count() <= GROUPS_BROADCAST else f
    y = x.join(side, x["lang"].eqNullSafe(side["lang"]) & x["source"].eqNullSafe(side["source"]), "left").select(x["*"], *(f"{m}_most" for m in MEASURES))
    fine = ~F.col("base_failed")
    for m in MEASURES:
        fine &= F.coalesce(F.col(m) <= F.col(f"{m}_most"), F.lit(True))
    return y.withColumn("kept", fine)


def _with_base(x: DataFrame) -> DataFrame:
    """``x`` with base_failed, behind a generator: a later filter can't pull the counting apart and repeat it."""
    x = x.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    carried = ("doc_id", "lang", "source")
    return x.select(*carried, F.explode(F.array(F.struct(*(c for c in x.columns if c not in carried)))).alias("m")).select(*carried, "m.*")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, base_failed, kept, the measures (in millionths) and the fences of its group.

    A null text counts as empty; it has no words, fails the base rule and is
    not kept. Null languages and sources are groups of their own. Repeated rows
    each count. Other columns are ignored.
    """
    x = written(_with_base(text_measures(docs, id_col, text_col)), "measures")
    return _judged(x, _fences(x)).select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES, *(f"{m}_most" for m in MEASURES))


def quality_keepers(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject; columns stay.

    The texts are read twice, for the fences and for the verdicts, and never moved.
    """
    names = docs.columns
    fences = _fences(written(_with_base(text_measures(docs)).drop("doc_id"), "measures"))
    rows = docs.select(F.struct(*names).alias("row"), "lang", "source", "text")
    return _judged(_with_base(text_measures(rows, "row")), fences).where("kept").select(*(F.col("doc_id")[c].alias(c) for c in names))
