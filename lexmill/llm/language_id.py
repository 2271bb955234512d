"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per page:

* the text, by naive Bayes over hashed byte trigrams, trained on all documents
  whose language is known; since neighbouring trigrams say the same thing
  several times, the log likelihood counts with ``TEMPER`` of its weight;
* the language that the page declares in its markup, by how often pages of
  each language declare it;
* the last label of the host's name, by how often hosts of each language bear it;
* the host, by the languages of its other pages.

The last three are learned from the pages by grouped aggregation over the
posterior of text and markup alone. A host's prior is shrunk toward its
suffix's, that toward the whole corpus's, each by as many pseudo-pages as
``STRENGTH`` says; a page is left out of its own host's and suffix's counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import mix, text_bytes, tune, written
from .html_text import declared_language, extract

CELLS = 1 << 15
TEMPER = 0.3
STRENGTH = 5.0


def trigram_cells(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and text number of every byte trigram (A-Z lower-cased) inside the texts."""
    x = data.astype(np.uint64)
    x = np.where((x >= 65) & (x <= 90), x + np.uint64(32), x)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tri = x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:]
    cell = (mix(tri) >> np.uint64(64 - 15)).astype(np.int64)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = owner[2:] == owner[:-2]
    return cell[inside], owner[:-2][inside]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each cell under each of them; what comes to the driver is one table of ``CELLS`` a language."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            data, off = text_bytes(b["text"])
            langs = np.array(b["lang"].to_pylist(), object)
            cell, owner = trigram_cells(data, off)
            for name in set(langs):
                mine = langs[owner] == name
                x = total.setdefault(name, np.zeros(CELLS + 1, np.int64))
                x[:-1] += np.bincount(cell[mine], minlength=CELLS)
                x[-1] += int((langs == name).sum())
        for name, x in total.items():
            some = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some), pa.array(x[some])], ["lang", "cell", "n"])

    got = rows.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(got[got.cell == CELLS].lang)
    table = np.full((len(langs), CELLS), 0.5)
    for k, name in enumerate(langs):
        mine = got[(got.lang == name) & (got.cell < CELLS)]
        table[k, mine.cell.to_numpy()] += mine.n.to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _normalised(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page: page_id, url, host, declared, text_lang, lang, posterior, and n_chars of its main text.

    Pages without text rest on markup, suffix and host alone. A null or
    malformed url has host '' and suffix ''; an undeclared language is a
    value of its own. Ties go to the language first in code-point order.
    Without any labelled documents lang is null.
    """
    spark = pages.sparkSession
    tune(spark)
    langs, table = train(docs)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host")).withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))
    if not langs:
        none = F.lit(None).cast("string")
        return rows.select("page_id", "url", "host", none.alias("declared"), none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(0).cast("long").alias("n_chars"))
    shared = spark.sparkContext.broadcast(table)

    def read(batches):
        logp = shared.value
        for b in batches:
            pages_ = b["html"].to_pylist()
            texts = [extract(x) for x in pages_]
            data, off = text_bytes(pa.array(texts, pa.string()))
            cell, owner = trigram_cells(data, off)
            like = np.stack([np.bincount(owner, row[cell], minlength=len(texts)) for row in logp], axis=1) * TEMPER
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in ("page_id", "url", "host", "suffix")), pa.array([declared_language(x) or "" for x in pages_]), pa.array(like.tolist(), pa.list_(pa.float64())), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "host", "suffix", "declared", "like", "n_chars"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    x = rows.mapInArrow(read, f"page_id {kind}, url string, host string, suffix string, declared string, like array<double>, n_chars long")
    names = F.array(*map(F.lit, langs))
    # what the text alone says, with a weak word for the declared language
    first = _normalised(F.zip_with("like", names, lambda v, n: v + F.when(n == F.col("declared"), F.lit(float(np.log(3.0)))).otherwise(0.0)))
    x = written(x.withColumn("resp", first), "evidence")
    k = len(langs)
    sums = lambda keys: x.groupBy(*keys).agg(*(F.sum(F.col("resp")[i]).alias(f"s{i}") for i in range(k)))
    packed = lambda df, keys, name: df.select(*keys, F.array(*(f"s{i}" for i in range(k))).alias(name))
    hosts = packed(sums(["host", "suffix"]), ["host", "suffix"], "by_host")
    suffixes = packed(sums(["suffix"]), ["suffix"], "by_suffix")
    said = packed(sums(["declared"]), ["declared"], "by_declared")
    all_ = x.agg(*(F.coalesce(F.sum(F.col("resp")[i]), F.lit(0.0)) for i in range(k)), F.count_distinct("declared")).first()
    whole = F.array(*(F.lit(float(v)) for v in all_[:k]))
    total = float(sum(all_[:k])) or 1.0
    n_said = float(all_[k] or 1)

    y = x.join(hosts, ["host", "suffix"], "left").join(suffixes, "suffix", "left").join(said, "declared", "left")
    corpus = F.transform(whole, lambda v: (v + 1.0 / k) / (total + 1.0))
    own = lambda c: F.zip_with(c, "resp", lambda v, r: F.greatest(v - r, F.lit(0.0)))
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    y = y.withColumn("cs", own("by_suffix")).withColumn("ch", own("by_host"))
    y = y.withColumn("ps", F.zip_with("cs", corpus, lambda v, g: (v + STRENGTH * g) / (size(F.col("cs")) + STRENGTH)))
    y = y.withColumn("ph", F.zip_with("ch", "ps", lambda v, g: (v + STRENGTH * g) / (size(F.col("ch")) + STRENGTH)))
    y = y.withColumn("pd", F.zip_with("by_declared", whole, lambda v, w: (v + 0.5) / (w + 0.5 * n_said)))
    logs = F.zip_with(F.zip_with("like", "ph", lambda a, b: a + F.log(b)), "pd", lambda a, b: a + F.log(b))
    y = y.withColumn("post", _normalised(logs))
    best = F.array_position("post", F.array_max("post"))
    alone = F.array_position("like", F.array_max("like"))
    return y.select(
        "page_id", "url", "host", F.nullif("declared", F.lit("")).alias("declared"), F.when(F.col("n_chars") > 0, F.element_at(names, alone.cast("int"))).alias("text_lang"),
        F.element_at(names, best.cast("int")).alias("lang"), F.array_max("post").alias("posterior"), "n_chars",
    )
