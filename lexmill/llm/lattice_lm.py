"""Language-model scores from a subword lattice.

The pieces come from an existing public vocabulary, those of every length;
nothing is cut or merged here. Rank files hold no scores, so their scores are
log probabilities learned from the training documents' distinct words by
expectation-maximisation. The probability of a word is the sum over all its
segmentations, by forward recursion in log space, and a word seen in training
has one arc more: itself as a whole.

    P(word) = max(c - D, 0) / N + (D * T / N) * sum over segmentations of prod p(piece)

c is the word's training count, N all training tokens, T the distinct words,
D the discount n1 / (n1 + 2 n2). The first piece of a word carries the leading
space and no other does, so the pieces' probabilities of all words add up to
one, and so do P(word) over all words and the end token (count: the training
documents, never discounted).

A document comes from one of a few classes of text, by the class column (the
language) of the training documents: the most frequent ``CLASSES - 1`` and one
for all others. Each has its own word probabilities, which the above smooth,

    P(word | class) = max(c - D, 0) / N + (D * T / N) * P(word), with the class's own c, N and T

and the class of the document to be scored isn't looked at: the probability of
its text is the sum over the classes, weighted by their training documents. So
it is a marginal over segmentations and classes, and sums to one over texts.

Every distinct word of the corpus is scored once, in a table; documents look
their words up there: the most frequent ones (at most ``HEAD`` words, so a
bounded broadcast) while the text is read, the rest by a join.
"""

from __future__ import annotations

import base64
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import gathered, tune, written

#: Words in the broadcast table.
HEAD = 1 << 18
ROUNDS = 3
#: Classes of text.
CLASSES = 8
FLUSH = 300_000
#: Words that the lattice works on at once.
WORDS = 1 << 16


def load_pieces(path: str) -> list[bytes]:
    """Byte pieces by rank from a rank file; those with white space other than one leading space are left out."""
    with open(path, "rb") as f:
        ranked = [(int(r), base64.b64decode(p)) for p, r in map(bytes.split, f)]
    out = [p for _, p in sorted(ranked) if p not in (b" ",) and len(p.lstrip(b" ").split()) == 1 and p.count(b" ") == p.startswith(b" ") and not any(c in p for c in b"\t\n\x0b\x0c\r")]
    lower = {p for p in out if not any(65 <= c <= 90 for c in p)}
    single = {bytes([i]) for i in range(256) if i not in b" \t\n\x0b\x0c\r"} | {b" " + bytes([i]) for i in range(256) if i not in b" \t\n\x0b\x0c\r"}
    kept = [p for p in out if p in lower]
    return kept + sorted(single - set(kept))


class Lattice:
    """All segmentations of many words at once: words of one length make a matrix, each arc a column operation."""

    _SLOTS = 20

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, np.append(logp, -np.inf)
        n = 1 << self._SLOTS
        self.keys, self.ids = np.zeros(n, np.uint64), np.full(n, len(pieces), np.int32)
        h = np.zeros(len(pieces), np.uint64)
        size = np.array([len(p) for p in pieces])
        # lengths of the pieces with the leading space, which only begin a word, and of the others
        self.lengths = [{len(p) for p in pieces if p.startswith(b" ") == first} for first in (True, False)]
        grid = np.zeros((len(pieces), max(size, default=0)), np.uint8)
        for i, p in enumerate(pieces):
            grid[i, : len(p)] = np.frombuffer(p, np.uint8)
        for j in range(grid.shape[1]):
            on = size > j
            h[on] = self._step(h[on], grid[on, j])
        self.probes = 0
        for i, x in enumerate(h.tolist()):
            at, k = self._slot(np.uint64(x)), 0
            while self.keys[(at + k) % n]:
                k += 1
            self.keys[(at + k) % n], self.ids[(at + k) % n] = x, i
            self.probes = max(self.probes, k + 1)

    @staticmethod
    def _step(h, byte):
        return (h ^ (byte.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15) + (h >> np.uint64(29)) + np.uint64(1)

    def _slot(self, h):
        with np.errstate(over="ignore"):
            return (((h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self._SLOTS)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = self._slot(h)
        out = np.where(self.keys[at] == h, self.ids[at], np.int32(len(self.pieces)))
        for k in range(1, self.probes):
            z = at + k & (1 << self._SLOTS) - 1
            hit = self.keys[z] == h
            if hit.any():
                out[hit] = self.ids[z[hit]]
        return out

    def _arcs(self, grid: np.ndarray) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each end position, the (start, piece ids) of its arcs."""
        n, size = grid.shape
        arcs: dict[int, list[tuple[int, np.ndarray]]] = {j: [] for j in range(1, size + 1)}
        for i in range(size):
            h = np.zeros(n, np.uint64)
            lengths = self.lengths[i > 0]
            for j in range(i + 1, min(size, i + max(lengths, default=0)) + 1):
                h = self._step(h, grid[:, j - 1])
                if j - i not in lengths:
                    continue
                ids = self._find(h)
                if (ids < len(self.pieces)).any():
                    arcs[j].append((i, ids))
        return arcs

    def _groups(self, words: list[bytes], cells: int = 1 << 20):
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(k)
        for size, rows in by.items():
            for a in range(0, len(rows), max(1, cells // size)):
                part = rows[a : a + max(1, cells // size)]
                yield part, np.frombuffer(b"".join(b" " + words[k] for k in part), np.uint8).reshape(len(part), size)

    def _forward(self, grid: np.ndarray, arcs) -> list[np.ndarray]:
        alpha = [np.zeros(len(grid))]
        for j in range(1, grid.shape[1] + 1):
            terms = [alpha[i] + self.logp[ids] for i, ids in arcs[j]]
            alpha.append(_logsum(terms, len(grid)))
        return alpha

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the marginal probability of each word over all its segmentations."""
        out = np.zeros(len(words))
        for rows, grid in self._groups(words):
            out[rows] = self._forward(grid, self._arcs(grid))[-1]
        return out

    def expected_counts(self, words: list[bytes]) -> np.ndarray:
        """How often each piece is used, over the posterior of every word's segmentations."""
        total = np.zeros(len(self.pieces) + 1)
        for _, grid in self._groups(words):
            arcs = self._arcs(grid)
            alpha = self._forward(grid, arcs)
            size = grid.shape[1]
            out_of: dict[int, list[tuple[int, np.ndarray]]] = {}
            for j, into in arcs.items():
                for i, ids in into:
                    out_of.setdefault(i, []).append((j, ids))
            beta: list[np.ndarray | None] = [None] * size + [np.zeros(len(grid))]
            for i in range(size - 1, -1, -1):
                beta[i] = _logsum([self.logp[ids] + beta[j] for j, ids in out_of.get(i, [])], len(grid))
            for j, into in arcs.items():
                for i, ids in into:
                    w = np.exp(alpha[i] + self.logp[ids] + beta[j] - alpha[size])
                    total += np.bincount(ids, w, minlength=len(total))
        return total[:-1]


def _logsum(terms: list[np.ndarray], n: int) -> np.ndarray:
    if not terms:
        return np.full(n, -np.inf)
    top = np.maximum.reduce(terms)
    safe = np.where(np.isfinite(top), top, 0.0)
    return safe + np.log(np.maximum(sum(np.exp(t - safe) for t in terms), 0), where=np.isfinite(top), out=np.full(n, -np.inf))


def _words(value: pa.Scalar) -> list[bytes]:
    return value.as_buffer().to_pybytes().lower().split() if value.is_valid else []


def _word_counts(docs: DataFrame, classes: int) -> DataFrame:
    """(word, c, cz): the training count of every distinct word of all documents, overall and by class."""

    def count(batches):
        train, other = [Counter() for _ in range(classes)], set()

        def flush():
            words = [w for t in train for w in t] + [*other]
            of = [z for z, t in enumerate(train) for _ in t] + [0] * len(other)
            n = [c for t in train for c in t.values()] + [0] * len(other)
            for t in (*train, other):
                t.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(of, pa.int32()), pa.array(n, pa.int64())], ["word", "z", "c"])

        for b in batches:
            for text, held, z in zip(b["text"].cast(pa.large_binary()), b["held_out"].to_pylist(), b["z"].to_pylist(), strict=True):
                (other if held else train[z]).update(_words(text))
                if sum(map(len, train)) + len(other) > FLUSH:
                    yield flush()
        yield flush()

    by_class = (F.sum(F.when(F.col("z") == k, F.col("c")).otherwise(0)) for k in range(classes))
    return docs.select("text", "held_out", "z").mapInArrow(count, "word binary, z int, c long").groupBy("word").agg(F.sum("c").alias("c"), F.array(*by_class).alias("cz"))


def _learned(types: DataFrame, pieces: list[bytes], rounds: int) -> np.ndarray:
    """Log probabilities of the pieces: each round sends a vector as long as the vocabulary from every task."""
    p = 1.0 / (np.arange(len(pieces)) + 50.0)
    logp = np.log(p / p.sum())
    sc = types.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast((pieces, logp))

        def expect(batches, shared=shared):
            lattice = Lattice(*shared.value)
            total = np.zeros(len(shared.value[0]))
            for b in gathered(batches, WORDS):
                total += lattice.expected_counts([x.as_py() for x in b["word"]])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["piece", "n"])

        got = types.where("c > 0").select("word").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        n = np.full(len(pieces), 0.01)
        n[got["piece"].to_numpy()] += got["n"].to_numpy()
        logp = np.log(n / n.sum())
    return logp


def lattice_scores(docs: DataFrame, pieces: list[bytes], held_out: str = "crc32(coalesce(cast(doc_id as string), '')) % 10 = 0", id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang") -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score and score (log10), as the module says.

    ``held_out`` is SQL that marks the documents the model doesn't learn from; a
    null id counts as held out by the default. A null or empty text is the end
    token alone. Repeated rows each give a row and count as often as they
    occur. A null class is a class. Without training documents base_score is 0
    and score comes from the pieces' first scores, with an even chance of the
    end before each word.
    """
    spark = docs.sparkSession
    tune(spark)
    kind = F.col(class_col).cast("string") if class_col in docs.columns else F.lit(None).cast("string")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.expr(held_out).alias("held_out"), kind.alias("kind"))
    ends_by = {r[0]: r[1] for r in docs.where("not held_out").groupBy("kind").count().orderBy(F.desc("count"), F.col("kind")).limit(CLASSES - 1).collect()}
    ends = docs.where("not held_out").count()
    z = F.lit(len(ends_by))
    for k, name in enumerate(ends_by):
        z = F.when(F.col("kind").eqNullSafe(F.lit(name)), k).otherwise(z)
    docs = docs.select("id", "text", "held_out", z.cast("int").alias("z"))
    ez = np.array([*ends_by.values(), ends - sum(ends_by.values())], float)
    classes = len(ez)
    counts = written(_word_counts(docs, classes), "words")
    s = counts.where("c > 0").agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), *(F.coalesce(F.sum(F.col("cz")[k]), F.lit(0)) for k in range(classes)), *(F.count_if(F.col("cz")[k] > 0) for k in range(classes))).first()
    types, total = s[0] + (ends > 0), s[1] + ends
    discount = s[2] / (s[2] + 2 * s[3]) if s[2] else 0.5
    rest = discount * s[0] / total if total and s[0] else 0.5
    below = total + 0.1 * (types + 1)
    p_end = ends / total if s[0] and ends else 0.5
    nz = np.array(s[4 : 4 + classes], float) + ez
    lower = np.where(nz > 0, discount * np.array(s[4 + classes :], float) / np.maximum(nz, 1), 1.0)
    with np.errstate(divide="ignore"):
        base_end, end = np.log10((ends + 0.1) / below), np.log10(ez / np.maximum(nz, 1) + lower * p_end)
        weight = np.log10(ez / ends) if ends else np.log10(np.full(classes, 1 / classes))
    logp = _learned(counts, pieces, ROUNDS) if s[0] else np.log(np.full(len(pieces), 1 / len(pieces)))
    shared = spark.sparkContext.broadcast((pieces, logp))

    def score(batches):
        lattice = Lattice(*shared.value)
        for b in gathered(batches, WORDS):
            c = b["c"].to_numpy()
            cz = b["cz"].flatten().to_numpy().reshape(-1, classes)
            sub = lattice.log_probs([x.as_py() for x in b["word"]])
            whole = np.maximum(c - discount, 0) / total if total else np.zeros(len(c))
            with np.errstate(divide="ignore"):
                lp = np.logaddexp(np.log(whole), np.log(rest) + sub)
                # in logs, as a long unknown word's probability can be too small for a double
                by = np.logaddexp(np.log(np.maximum(cz - discount, 0) / np.maximum(nz, 1)), np.log(lower) + lp[:, None]) / np.log(10)
            ys = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * classes, pa.int32()), pa.array(by.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b["word"], b["c"], pa.array(np.log10((c + 0.1) / below)), ys], ["word", "c", "base", "ys"])

    scored = written(counts.mapInArrow(score, "word binary, c long, base double, ys array<double>"), "scored")
    # the count from which at most HEAD words remain, by eighths of powers of two
    step = F.when(F.col("c") > 0, F.floor(F.log2("c") * 8)).otherwise(-1)
    room, cut = HEAD, None
    for k, n in sorted(scored.groupBy(step.cast("int").alias("k")).count().toArrow().to_pandas().itertuples(index=False), reverse=True):
        if n > room:
            break
        room, cut = room - n, k
    head = scored.where(step >= cut if cut is not None else F.lit(False)).toArrow().combine_chunks()
    ys = np.concatenate([x.flatten().to_numpy() for x in head["ys"].chunks] or [np.zeros(0)]).reshape(-1, classes)
    top = spark.sparkContext.broadcast((head["word"].to_pylist(), head["c"].to_numpy() > 0, head["base"].to_numpy(), ys))

    def read(batches):
        from pyspark import TaskContext

        words, known, base, scores = top.value
        find = {w: i for i, w in enumerate(words)}.get
        known, base, scores = np.append(known, False), np.append(base, 0.0), np.concatenate([scores, np.zeros((1, classes))])
        none, row = len(words), TaskContext.get().partitionId() << 33
        for b in batches:
            n, m, x, y, tail, tf = [], [], [], [], [], []
            for text in b["text"].cast(pa.large_binary()):
                ws = _words(text)
                at = np.array([find(w, none) for w in ws], np.int64)
                n.append(len(ws) + 1)
                m.append(int(known[at].sum()))
                x.append(float(base[at].sum()))
                y.append(scores[at].sum(axis=0))
                rare = Counter([ws[i] for i in np.flatnonzero(at == none)])
                tail.append(list(rare.keys()))
                tf.append(list(rare.values()))
            rid = np.arange(row, row + len(n))
            row += len(n)
            yield pa.RecordBatch.from_arrays([pa.array(rid), b["id"], b["held_out"], pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(x, pa.float64()), pa.array([v.tolist() for v in y], pa.list_(pa.float64())), pa.array(tail, pa.list_(pa.binary())), pa.array(tf, pa.list_(pa.int64()))], ["rid", "id", "held_out", "n", "m", "x", "y", "tail", "tf"])

    kind = docs.schema["id"].dataType.simpleString()
    rows = written(docs.mapInArrow(read, f"rid long, id {kind}, held_out boolean, n long, m long, x double, y array<double>, tail array<binary>, tf array<long>"), "rows")
    rare = rows.select("rid", F.explode(F.arrays_zip("tail", "tf")).alias("t")).select("rid", F.col("t.tail").alias("word"), F.col("t.tf").alias("tf"))
    found = rare.join(scored.where(step < cut if cut is not None else F.lit(True)), "word").groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("m2"), F.sum(F.col("tf") * F.col("base")).alias("x2"),
        *(F.sum(F.col("tf") * F.col("ys")[k]).alias(f"y{k}") for k in range(classes)),
    )
    plus = lambda a, b, c: F.col(a) + F.coalesce(b, F.lit(0)) + F.lit(c)
    per = F.array(*(F.col("y")[k] + F.coalesce(f"y{k}", F.lit(0)) + F.lit(float(end[k] + weight[k])) for k in range(classes) if np.isfinite(weight[k])))
    marginal = F.expr("top + log10(aggregate(per, 0D, (a, v) -> a + pow(10D, v - top)))")
    return rows.drop("tail", "tf").join(found, "rid", "left").withColumn("per", per).withColumn("top", F.array_max("per")).select(
        F.col("id").alias(id_col), "held_out", F.col("n").alias("n_tokens"), plus("m", "m2", int(ends > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), plus("x", "x2", float(base_end)).alias("base_score"), marginal.alias("score"),
    )
