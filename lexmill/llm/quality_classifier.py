"""Quality and toxicity by hierarchical empirical Bayes.

A logistic classifier over hashed words and shapes gives the evidence of each
document for each label, from the features that go with the label beyond
chance. It is fitted on at most ``SAMPLE`` labelled documents (the
least hashes of their ids; a parameter). Everything after that covers all
documents: evidence is averaged over each site and each path of a site by
grouped aggregation, and a group of n documents and strength a has the
posterior mean (sum + a * parent) / (n + a), where the parent of a path is its
site and that of a site the corpus. The strengths are those that make the
spread between groups what it is beyond the spread within them (method of
moments). A document's own evidence is taken out of its groups, and its
posterior adds the path's log odds, relative to the corpus, to its own.

In the ``documents`` table a site is a source and a path a language within it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_bytes, tune, word_bounds, word_hashes, written

SAMPLE = 8000
CELL_BITS = 21
SHAPES = 6
LABELS = ("quality", "toxic")
STEPS = 30
PENALTY = 0.1
#: The chance that a feature is kept for nothing.
CHANCE = 0.05
#: How far a group may move a document's log odds.
MOST_SHIFT = 1.0


def features(column: pa.Array) -> list[np.ndarray]:
    """Ascending distinct feature numbers of each text: its words by hash, and bands of six shares of its bytes."""
    data, off = text_bytes(column)
    start, end = word_bounds(data, off)
    # edge punctuation doesn't make another word
    edge = np.zeros(256, bool)
    edge[[ord(c) for c in ".,;:!?\"'()"]] = True
    for _ in range(2):
        long = end - start > 1
        end = end - (long & edge[data[np.maximum(end - 1, 0)]]) if len(end) else end
    h = (word_hashes(data, start, end) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
    first = np.searchsorted(start, off)
    groups = [np.isin(np.arange(256), [ord(c) for c in s]) for s in ("#*$%&|<>", "!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;", "\n")]
    sums = [np.concatenate([[0], np.cumsum(g[data])]) for g in groups]
    out = []
    for r in range(len(off) - 1):
        a, b = off[r], off[r + 1]
        n = max(int(b - a), 1)
        shape = [(1 << CELL_BITS) + 16 * k + min(15, int(100 * (s[b] - s[a]) / n)) for k, s in enumerate(sums)]
        out.append(np.concatenate([np.unique(h[first[r] : first[r + 1]]), shape]).astype(np.int64))
    return out


WIDTH = (1 << CELL_BITS) + 16 * SHAPES + 1


def telling(at: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features whose presence goes with the label beyond chance: likelihood ratio above the bound for this many tests."""
    n, pos = len(y), y.sum()
    k = np.bincount(at, minlength=WIDTH).astype(np.float64)
    a = np.bincount(at, y[doc], minlength=WIDTH)
    seen = k >= 3
    cells = ((a, k * pos / n), (k - a, k * (n - pos) / n), (pos - a, (n - k) * pos / n), (n - k - pos + a, (n - k) * (n - pos) / n))
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * sum(np.where(o > 0, o * np.log(o / e), 0.0) for o, e in cells)
    return seen & (np.nan_to_num(g2) > 2 * np.log(max(int(seen.sum()), 1) / CHANCE))


def _solved(times, diagonal: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with times(x) = b for a positive definite ``times``, by conjugate gradients scaled by its diagonal."""
    x, r = np.zeros(len(b)), b.copy()
    z = r / diagonal
    d, rz = z, r @ z
    least = 1e-20 * rz
    for _ in range(10 * len(b) + 100):
        if rz <= least:
            break
        t = times(d)
        a = rz / (d @ t)
        x, r = x + a * d, r - a * t
        z = r / diagonal
        rz, old = r @ z, rz
        d = z + rz / old * d
    return x


def fit(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Logistic weights (the last is the bias) on the telling features, by Newton steps with an L2 penalty; repeatable."""
    w = np.zeros(WIDTH)
    if not len(rows) or y.min() == y.max():
        w[-1] = 0.0 if not len(rows) else (4.0 if y[0] else -4.0)
        return w
    at = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    keep = telling(at, doc, y)
    names = np.flatnonzero(keep)
    place = np.full(WIDTH, -1)
    place[names] = np.arange(len(names))
    on = place[at] >= 0
    # the ones of a sparse matrix of presences; the last column is the bias
    col, row = np.append(place[at[on]], np.full(len(rows), len(names))), np.append(doc[on], np.arange(len(rows)))
    times = lambda v: np.bincount(row, v[col], len(rows))
    back = lambda r: np.bincount(col, r[row], len(names) + 1)
    ridge = np.full(len(names) + 1, PENALTY)
    ridge[-1] = 1e-6
    v = np.zeros(len(names) + 1)
    v[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(times(v), -30, 30)))
        q = p * (1 - p)
        step = _solved(lambda d: back(q * times(d)) + ridge * d, back(q) + ridge, back(y - p) - ridge * v)  # noqa: B023
        v += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    w[names], w[-1] = v[:-1], v[-1]
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """One weight vector for each of ``LABELS``, from at most ``sample`` documents that have them."""
    own = labels.select("doc_id", *LABELS).dropna().dropDuplicates(["doc_id"])
    total = own.count()
    # a hash threshold, so that no sort is needed; it leaves about ``sample`` documents
    part = own if total <= sample else own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * sample / total))
    rows = F.broadcast(part).join(docs.select("doc_id", "text"), "doc_id")

    def read(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(b[c] for c in LABELS), pa.array(features(b["text"]), pa.list_(pa.int64()))], ["doc_id", *LABELS, "f"])

    kinds = ", ".join(f"{c} int" for c in LABELS)
    got = rows.select("doc_id", *(F.col(c).cast("int").alias(c) for c in LABELS), "text").mapInArrow(read, f"doc_id long, {kinds}, f array<long>").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    f = got["f"].to_pylist()
    x = [np.array(f[i], np.int64) for i in order]
    return np.stack([fit(x, got[c].to_numpy()[order].astype(np.float64)) for c in LABELS])


def _strength(groups: DataFrame, name: str) -> float:
    """Pseudo-documents by which groups shrink: within-group variance over between-group variance, 1 to 1000."""
    s = groups.where("n > 1").agg(F.count("*"), F.sum("n"), F.sum(f"{name}_s"), F.sum(F.col(f"{name}_s") ** 2 / F.col("n")), F.sum(f"{name}_q"), F.sum(F.col("n") ** 2)).first()
    k, n, total, squares, q, n2 = (float(v or 0) for v in s)
    if k < 2 or n <= k:
        return 10.0
    within = max(q - squares, 1e-12) / (n - k)
    between = (squares - total**2 / n - (k - 1) * within) / max(n - n2 / n, 1e-12)
    return float(min(max(within / between if between > 0 else 1000.0, 1.0), 1000.0))


def classify(docs: DataFrame, labels: DataFrame, site_col: str = "source", path_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, site, path, quality_own, toxic_own (evidence), quality, toxic (posteriors), kept.

    kept: quality is one half or more and toxicity less. Null sites and paths
    are groups of their own; a null text counts as empty; repeated rows each
    give a row and count as often. Without labels evidence is one half.
    """
    spark = docs.sparkSession
    tune(spark)
    weights = spark.sparkContext.broadcast(train(docs, labels, sample))
    rows = docs.select("doc_id", F.col(site_col).cast("string").alias("site"), F.col(path_col).cast("string").alias("path"), "text")

    def judge(batches):
        for b in batches:
            x = features(b["text"])
            size = np.array([len(r) for r in x])
            at = np.concatenate(x) if x else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(x)), size)
            cols = []
            for w in weights.value:
                z = np.bincount(doc, w[at], minlength=len(x)) + w[-1]
                cols.append(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["site"], b["path"], *cols], ["doc_id", "site", "path", *(f"{c}_own" for c in LABELS)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    x = written(rows.mapInArrow(judge, f"doc_id {kind}, site string, path string, " + ", ".join(f"{c}_own double" for c in LABELS)), "evidence")
    measures = [F.count("*").alias("n"), *(F.sum(f"{c}_own").alias(f"{c}_s") for c in LABELS), *(F.sum(F.col(f"{c}_own") ** 2).alias(f"{c}_q") for c in LABELS)]
    paths = written(x.groupBy("site", "path").agg(*measures), "paths")
    again = [F.sum(c).alias(c) for c in ("n", *(f"{c}_{k}" for c in LABELS for k in "sq"))]
    sites = paths.groupBy("site").agg(*again)
    corpus = sites.agg(*again).first()
    total = float(corpus["n"] or 0)
    out = x
    p = paths.select(F.col("site").alias("ps"), F.col("path").alias("pp"), F.col("n").alias("pn"), *(F.col(f"{c}_s").alias(f"{c}_p") for c in LABELS))
    s = sites.select(F.col("site").alias("ss"), F.col("n").alias("sn"), *(F.col(f"{c}_s").alias(f"{c}_t") for c in LABELS))
    out = out.join(p, out["site"].eqNullSafe(p["ps"]) & out["path"].eqNullSafe(p["pp"])).join(s, out["site"].eqNullSafe(s["ss"]))
    posts = []
    for c in LABELS:
        mean = min(max(float(corpus[f"{c}_s"] or 0) / total, 1e-4), 1 - 1e-4) if total else 0.5
        a_site, a_path = _strength(sites, c), _strength(paths, c)
        own = F.col(f"{c}_own")
        at_site = (F.col(f"{c}_t") - own + a_site * mean) / (F.col("sn") - 1 + a_site)
        at_path = (F.col(f"{c}_p") - own + a_path * at_site) / (F.col("pn") - 1 + a_path)
        safe = lambda v: F.least(F.greatest(v, F.lit(1e-9)), F.lit(1 - 1e-9))
        logit = lambda v: F.log(safe(v) / (1 - safe(v)))
        shift = F.least(F.greatest(logit(at_path) - float(np.log(mean / (1 - mean))), F.lit(-MOST_SHIFT)), F.lit(MOST_SHIFT))
        posts.append((1 / (1 + F.exp(-(logit(own) + shift)))).alias(c))
    return out.select("doc_id", "site", "path", *(f"{c}_own" for c in LABELS), *posts).withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))
