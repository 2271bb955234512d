"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with k edits, k = m // PIECE - 1. Cut
into k + 1 pieces, at least one piece occurs unchanged, so an Aho-Corasick
automaton over all pieces finds every place worth a look. Hits of one item on
nearby diagonals make one window; Myers' bit-parallel distance over the window
decides. Texts and items are compared in lower case with white space runs as
one space.

The items go to the workers in blocks of at most about ``BLOCK_CHARS``
characters; a larger benchmark takes more passes over the documents.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, tune

PIECE = 16
#: Items of fewer characters must occur as they are and between word borders: inside words they occur by chance.
SHORT = 24
BLOCK_CHARS = 8_000_000


#: Scripts that set no spaces between words, so that every place is a border.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def joined(left: str, right: str) -> bool:
    """Whether two neighbouring characters belong to one word."""
    return all(c and unicodedata.category(c)[0] in "LMN" and not _UNSPACED.match(c) for c in (left, right))


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int, piece: int = PIECE) -> int:
    return max(m // piece - 1, 0)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces (offset, text) of near-equal length that make up the item."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def pattern_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def nearest(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to the item (first of equals), by Myers' bit vectors."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], piece: int = PIECE):
        import ahocorasick

        self.items: dict[str, tuple[list[int], int, dict[str, int]]] = {}
        for i, t in items:
            if t:
                self.items.setdefault(t, ([], budget(len(t), piece), pattern_masks(t)))[0].append(i)
        self.auto = ahocorasick.Automaton()
        where: dict[str, list[tuple[str, int]]] = {}
        for t, (_, k, _) in self.items.items():
            for at, p in pieces(t, k):
                where.setdefault(p, []).append((t, at))
        for p, uses in where.items():
            self.auto.add_word(p, (len(p), uses))
        if where:
            self.auto.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, end, edits allowed) of each item's best place in a normal text."""
        if not self.items or not text:
            return []
        diagonals: dict[str, set[int]] = {}
        for last, (size, uses) in self.auto.iter(text):
            for t, at in uses:
                diagonals.setdefault(t, set()).add(last + 1 - size - at)
        found = []
        for t, ds in diagonals.items():
            ids, k, masks = self.items[t]
            m, best = len(t), None
            run = sorted(ds)
            if m < SHORT:
                whole = (a for a in run if not joined(text[a - 1 : a], t[0]) and not joined(t[-1], text[a + m : a + m + 1]))
                if (a := next(whole, None)) is not None:
                    found += [(x, 0, a + m, k) for x in ids]
                continue
            i = 0
            while i < len(run):
                j = i
                while j + 1 < len(run) and run[j + 1] - run[j] <= 2 * k + 1:
                    j += 1
                a, z = max(0, run[i] - k), min(len(text), run[j] + m + k)
                d, end = nearest(masks, m, text[a:z])
                if d <= k and (best is None or d < best[0]):
                    best = (d, a + end)
                i = j + 1
            if best:
                found += [(x, best[0], best[1], k) for x in ids]
        return found


def _blocks(items: DataFrame) -> list[list[tuple[int, str]]]:
    """The items on the driver, one block at a time; every block's size is known before it is read."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    n = -(-total // BLOCK_CHARS) or 1
    while n > 1 and items.groupBy(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("b")).agg(F.sum(F.char_length("text")).alias("z")).agg(F.max("z")).first()[0] > 2 * BLOCK_CHARS and n < total:
        n *= 2
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        rows = part.toArrow()
        yield list(zip(rows["item_id"].to_pylist(), map(normal, rows["text"].to_pylist()), strict=True))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: id, item_id, distance, allowed, end (in the normal text).

    Null and empty texts match nothing; items of fewer than ``SHORT``
    characters match without edits, between word borders. Equal items are all reported; repeated
    documents repeat their rows. Null ids are carried along.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item_id long, distance int, allowed int, end long"
    out = None
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            matcher = Matcher(shared.value)
            for b in batches:
                at, cols = [], ([], [], [], [])
                for r, t in enumerate(b["text"].to_pylist()):
                    for item, d, end, k in matcher(normal(t)):
                        at.append(r)
                        for c, v in zip(cols, (item, d, k, end), strict=True):
                            c.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "item_id", "distance", "allowed", "end"])

        part = rows.mapInArrow(lean(search), schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in whose text an item of the benchmark is found. Works row by row, in as many passes as blocks."""
    spark = docs.sparkSession
    tune(spark)
    out = docs
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def sift(batches, shared=shared):
            matcher = Matcher(shared.value)
            for b in batches:
                yield b.filter(pa.array([not matcher(normal(t)) for t in b["text"].to_pylist()], pa.bool_()))

        out = out.mapInArrow(lean(sift), docs.schema)
    return out
