"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target of words. A document of a source is wanted
``target / source_size`` times; the whole part is certain, for all documents,
and the fraction is the inclusion probability p of one copy more. Documents
are ranked by the odds of a random number in (0, 1), made from the id, divided
by the odds of p; a source takes the least ranks until its words are filled.
Probabilities differ between sources and, with ``weight_col``, within one.

The fill is by words: documents in rank order while they fit, then the one
document that best closes what is left. Ranks are summed in bins of about
``BIN`` documents; only the bin where a source's words run out is ordered
document by document, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD_PATTERN, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BIN = 4096
SOURCES_BROADCAST = 100_000
SEED = "lexmill-mix"


def _targets(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size, n, target): weights in code-point order of source, capped at ``MOST`` times a source's size.

    With b = MOST * size / weight, the sources of the least b are capped; the
    others share what is left by weight. One row a source.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    src = src.withColumn("w", weight).withColumn("cap", F.col("source_size") * MOST).withColumn("b", F.col("cap") / F.col("w"))
    up = Window.orderBy("b", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    src = (
        src.withColumn("total", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
        .withColumn("capped", F.sum("cap").over(up)).withColumn("used_w", F.sum("w").over(up))
    )
    # the share per weight if this source and all of lesser b were capped, where that stays true
    share = F.when(F.col("all_w") - F.col("used_w") > 0, (F.col("total") - F.col("capped")) / (F.col("all_w") - F.col("used_w")))
    full = F.col("b") * (F.col("all_w") - F.col("used_w") + F.col("w")) <= F.col("total") - F.col("capped") + F.col("cap")
    src = src.withColumn("full", full).withColumn("share", F.when(F.col("full"), share))
    level = F.coalesce(F.max_by(F.when(F.col("full"), F.col("share")), F.when(F.col("full"), F.col("used_w"))).over(every), F.col("total") / F.col("all_w"))
    return src.select("source", "source_size", "n", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * level).alias("target"))


def _key(source: str) -> Column:
    """A source as a key without nulls."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _ranked(rows: DataFrame, plan: DataFrame, id_col: str, seed: str, weighted: bool) -> DataFrame:
    """``rows`` (sk, size, u and others) with the source's columns and with sure, rank and bin, row by row."""
    x = rows.join(F.broadcast(plan) if plan.count() <= SOURCES_BROADCAST else plan, "sk")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    x = x.withColumn("want", F.least(rate * F.col("u") / F.coalesce("mean_u", F.lit(1.0)), F.lit(float(MOST))))
    x = x.withColumn("sure", F.floor("want")).withColumn("p", F.col("want") - F.col("sure"))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double")
    rand = (key + 0.5) / float(1 << 48)
    odds = F.col("p") / (1 - F.col("p"))
    x = x.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), rand / (1 - rand) / odds))
    # even bins: the rank as a number in (0, 1) again, at the source's own odds where they are one number
    flat = F.col("rank") * (F.lit(1.0) if weighted else odds)
    return x.withColumn("bin", F.floor(flat / (1 + flat) * F.greatest(F.ceil(F.col("n") / BIN), F.lit(1)))).drop("want", "p")


def _plan(sizes: DataFrame, weights: tuple[float, ...], seed: str, weighted: bool) -> DataFrame:
    """One row a source: its target and, for the copy beyond the certain ones, the rank up to which documents are taken and the one taken besides."""
    mean = sizes.groupBy("sk").agg((F.sum(F.col("size") * F.col("u")) / F.sum("size")).alias("mean_u"))
    src = written(_targets(sizes, weights).withColumn("sk", _key("source")).drop("source").join(mean, "sk"), "targets")
    x = written(_ranked(sizes.drop("source"), src, "doc_id", seed, weighted).select("sk", "doc_id", "size", "target", "sure", "rank", "bin"), "ranked")
    sure = x.groupBy("sk").agg((F.max("target") - F.sum(F.col("sure") * F.col("size"))).alias("open"))
    bins = x.where("bin is not null").groupBy("sk", "bin").agg(F.sum("size").alias("words"), F.max("rank").alias("top")).join(sure, "sk")
    run = Window.partitionBy("sk").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("after", F.sum("words").over(run)).withColumn("before", F.col("after") - F.col("words"))
    whole = bins.where("after <= open").groupBy("sk").agg(F.max("top").alias("whole"))
    split = bins.where("before < open and after > open").select("sk", "bin", (F.col("open") - F.col("before")).alias("left"))
    edge = x.join(split, ["sk", "bin"])
    # rows of one rank (repeats of an id) go together
    edge = edge.withColumn("fits", F.sum("size").over(Window.partitionBy("sk").orderBy("rank")) <= F.col("left"))
    own = Window.partitionBy("sk")
    edge = edge.withColumn("gap", F.col("left") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))).over(own), F.lit(0)))
    off = F.abs(F.col("size") - F.col("gap"))
    best = F.min(F.when(~F.col("fits") & (off < F.col("gap")), F.struct(off.alias("off"), "rank", "size")))
    cut = edge.groupBy("sk").agg(F.max(F.when(F.col("fits"), F.col("rank"))).alias("part"), best.alias("best"))
    return src.join(whole, "sk", "left").join(cut, "sk", "left").select(*src.columns, F.coalesce(F.greatest("whole", "part"), F.lit(-1.0)).alias("upto"), F.col("best.rank").alias("also_rank"), F.col("best.size").alias("also_size"))


def _copies() -> Column:
    also = (F.col("rank") == F.col("also_rank")) & (F.col("size") == F.col("also_size"))
    more = F.coalesce((F.col("rank") <= F.col("upto")) | F.coalesce(also, F.lit(False)), F.lit(False))
    return (F.col("sure") + more.cast("long")).cast("long")


def _sized(docs: DataFrame, weight_col: str | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    weight = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_PATTERN)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), weight.alias("u"), _key(source_col).alias("sk"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, weight_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """One row per document: its id, size, source_size, target, taken, and copies (0 to ``MOST``).

    A null source is a source of its own, the last; a null or blank text has
    size 0 and is never taken. Rows that repeat an id share its random number
    and rank, and are taken or left together. ``weight_col`` (positive) scales
    the wanted copies within a source.
    """
    sizes = written(_sized(docs, weight_col, id_col, text_col, source_col), "sizes")
    plan = written(_plan(sizes, weights, seed, weight_col is not None), "plan")
    x = _ranked(sizes.drop("source"), plan, "doc_id", seed, weight_col is not None).withColumn("copies", _copies())
    return x.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns. Texts are read twice and never moved."""
    names = docs.columns
    sizes = written(_sized(docs, None, "doc_id", "text", "source"), "sizes")
    plan = written(_plan(sizes, weights, SEED, False), "plan")
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long")
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("doc_id"), size.alias("size"), F.lit(1.0).alias("u"), _key("source").alias("sk"))
    x = _ranked(rows, plan, "doc_id", SEED, False).withColumn("copies", _copies())
    nth = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int")))
    return x.select("row", F.explode(nth).alias("nth")).select(*(F.col("row")[c].alias(c) for c in names))
