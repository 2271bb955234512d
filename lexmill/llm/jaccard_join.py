"""N-gram Jaccard join with adaptive multi-match prefixes.

Two sets with Jaccard similarity of t or more share at least
``r = ceil(t * size)`` members of either. Under one global order of the
shingles, each of them therefore shares ``l`` members with the other among its
first ``size - r + l``. Every set picks its own ``l`` from the estimated cost
of its candidates: a longer prefix reads more postings but asks for more
common members before a pair is verified. A pair is verified when it shares
``min(l, l')`` members within the two prefixes; no similar pair is lost.

The order puts rare shingles first. Rarity comes from a counting sketch over
all documents (``2**CELL_BITS`` counters, so its size is known whatever the
input); ties go by hash. The order only affects speed.

Sets are collapsed to distinct ones first, and only those of like sizes meet. A candidate pair must also pass
bounds that hold for every similar pair: sizes, positions in the two prefixes,
and the parity sketch (each member flips one of 256 bits, so differing bits
never outnumber differing members). Linking happens in two passes: each
posting list against its first member, then what still lies in different
components. So a group of near copies costs about its size, not its square.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD_PATTERN, bitmap_of, forget, in_bitmap, lean, shingle_sets, tune, written
from ._graph import components

CELL_BITS = 22
SLICES = 64
#: Postings of one member on one task of the second pass.
SALT_ROWS = 4096
MAX_MATCH = 4
#: What verifying a pair costs, in postings read.
VERIFY_COST = 8.0
#: Bits of the map of members worth a join; where it is full, all go to the join.
BITMAP_BITS = 24

_RECORD = "id long, n int, ck binary, s0 long, s1 long, s2 long, s3 long, l int, prefix array<long>"


def _ceil(num: int, den: int, n: np.ndarray | int):
    return -(-num * n // den)


def _key(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _count_cells(docs: DataFrame, k: int) -> np.ndarray:
    """How many sets hold a shingle of each cell: one pass, merged in slices of fixed size."""
    width = (1 << CELL_BITS) // SLICES

    def count(batches):
        total = np.zeros(1 << CELL_BITS, np.int32)
        for b in batches:
            for s in shingle_sets(b["text"], k):
                np.add.at(total, (s >> np.uint64(64 - CELL_BITS)).astype(np.int64), np.int32(1))
        if total.any():
            parts = total.reshape(SLICES, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(p.astype(np.int64).tobytes(), 1) for p in parts], pa.binary())], ["slice", "cells"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b["slice"].to_pylist(), b["cells"].to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(c), np.int64)
                total[i] = total[i] + x if i in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([zlib.compress(np.minimum(x, 2**31 - 1).astype(np.int32).tobytes(), 1) for x in total.values()], pa.binary())], ["slice", "cells"])

    schema = "slice int, cells binary"
    got = docs.select("text").mapInArrow(lean(count), schema).repartition(SLICES, "slice").mapInArrow(lean(merge), schema).toArrow()
    out = np.zeros((SLICES, width), np.int32)
    for i, c in zip(got["slice"].to_pylist(), got["cells"].to_pylist(), strict=True):
        out[i] = np.frombuffer(zlib.decompress(c), np.int32)
    return out.reshape(-1)


def match_length(freq: np.ndarray, least: int) -> int:
    """How many common members a set asks for: of the prefixes of ``least + 1`` to ``least + MAX_MATCH`` members the cheapest.

    Reading a prefix costs its members' estimated postings; a candidate met
    there is verified only once ``m`` of them agree.
    """
    read = np.cumsum(freq[: least + MAX_MATCH])
    cost = [read[min(least + m, len(read)) - 1] * (1 + VERIFY_COST / m) for m in range(1, MAX_MATCH + 1)]
    return int(np.argmin(cost)) + 1


def _records(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """A row for each document: its set's size, key, parity sketch, match length l and prefix, and its other columns."""
    more = [c for c in docs.columns if c not in ("id", "text")]
    counts = _count_cells(docs, k)
    # what other members add to a cell on average is no sign of this one's postings
    load = int(counts.sum(dtype=np.int64)) >> CELL_BITS
    cells = docs.sparkSession.sparkContext.broadcast((counts, load))

    def describe(batches):
        freq, load = cells.value
        for b in batches:
            n, ck, sig, match, prefix = [], [], [], [], []
            for s in shingle_sets(b["text"], k):
                least = len(s) - _ceil(num, den, len(s))
                f = freq[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                order = np.lexsort((s, f))[: least + MAX_MATCH]
                m = match_length(np.maximum(f[order].astype(np.int64) - load, 1), least) if len(s) else 1
                n.append(len(s))
                match.append(m)
                ck.append(_key(s))
                bits = np.bincount(((s >> np.uint64(11)) & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1
                sig.append(np.packbits(bits).view(np.int64))
                prefix.append(s[order[: least + m]].view(np.int64))
            sig = np.array(sig, np.int64).reshape(-1, 4)
            sizes = np.cumsum([0] + [len(p) for p in prefix])
            flat = pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array(n, pa.int32()), pa.array(ck, pa.binary()), *(pa.array(sig[:, i]) for i in range(4)), pa.array(match, pa.int32()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat), *(b[c] for c in more)],
                ["id", "n", "ck", "s0", "s1", "s2", "s3", "l", "prefix", *more],
            )

    return docs.mapInArrow(lean(describe), ", ".join([_RECORD, *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in more)]))


def _postings(recs: DataFrame, num: int, den: int) -> DataFrame:
    """(tok, w, ck, n, pos, l, s0..s3): prefix members that occur in two prefixes or more of like sizes.

    A member stands for one of each class of sizes that a partner no smaller
    can have; classes are wide enough that two in three sets need only one.
    Members with the same posting list, as near copies have by the hundred, are
    kept as one: the first of them in the global order, with their number w.
    """
    # nid: 64 bits of the key, for narrow rows; two sets that share it would only share candidates, which are verified
    sets = recs.where("n > 0").dropDuplicates(["ck"]).withColumn("nid", F.xxhash64("ck"))
    size_class = lambda n: F.floor(F.log(n) / F.lit(3 * math.log(den / num))) if num < den else F.col("n")
    classes = F.sequence(size_class(F.col("n")), size_class(F.expr(f"n * {den} div {num}")))
    narrow = sets.select("nid", classes.alias("of"), F.posexplode("prefix").alias("pos", "tok")).select("nid", "pos", "tok", F.explode("of").alias("of"))
    narrow = written(narrow.select("nid", "pos", F.xxhash64("tok", "of").alias("tok")), "narrow")
    # a list is told from others by its length and two sums over its sets; the one whose first place is least comes first in all of them
    lists = narrow.groupBy("tok").agg(F.count("*").alias("f"), F.bit_xor("nid").alias("x"), F.sum(F.xxhash64("nid").cast("decimal(38,0)")).alias("y"), F.min("pos").alias("p")).where("f > 1")
    heads = written(lists.groupBy("f", "x", "y").agg(F.count("*").alias("w"), F.min(F.struct("p", "tok")).alias("h")).select(F.col("h.tok").alias("tok"), "w"), "heads")
    bits = narrow.sparkSession.sparkContext.broadcast(bitmap_of(heads.select(F.shiftrightunsigned("tok", 64 - BITMAP_BITS).alias("cell")), "cell", BITMAP_BITS))

    def likely(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(bits.value, b["tok"].to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP_BITS))))

    thin = narrow.mapInArrow(lean(likely), narrow.schema).join(heads, "tok")
    out = written(thin.join(sets.select("nid", "ck", "n", "l", "s0", "s1", "s2", "s3"), "nid").drop("nid"), "postings")
    forget(narrow)
    forget(heads)
    return out


def _close(a: str, b: str, num: int, den: int) -> str:
    """SQL for what holds of every similar pair at each of its first l common members."""
    apart = f"(({a}.n + {b}.n) * {den - num} div {den + num})"
    bits = " + ".join(f"bit_count({a}.s{i} ^ {b}.s{i})" for i in range(4))
    return (
        f"{den} * least({a}.n, {b}.n) >= {num} * greatest({a}.n, {b}.n)"
        f" and {a}.pos + {b}.pos <= {apart} + 2 * (least({a}.l, {b}.l) - 1)"
        f" and {bits} <= {apart}"
    )


def _shared(pairs: DataFrame) -> DataFrame:
    """Distinct pairs that share as many prefix members as the shorter of the two prefixes asks for."""
    return pairs.groupBy("u", "v").agg(F.sum("w").alias("m"), F.max("l").alias("l")).where("m >= l").select("u", "v")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs whose sets really are similar; the sets are made anew from the texts that occur in pairs."""
    pairs = written(pairs, "pairs")
    wanted = pairs.select(F.col("u").alias("ck")).unionByName(pairs.select(F.col("v").alias("ck"))).distinct()
    cell = F.conv(F.hex(F.substring("ck", 1, 3)), 16, 10).cast("long")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(cell.alias("cell")), "cell", 24))

    def sets(batches):
        sent = set()  # a text's copies in one task are sent once
        for b in batches:
            ck, members = [], []
            for s in shingle_sets(b["text"], k):
                key = _key(s)
                c = int.from_bytes(key[:3], "big")
                if len(s) and key not in sent and bits.value[c >> 6] >> np.uint64(c & 63) & np.uint64(1):
                    sent.add(key)
                    ck.append(key)
                    members.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ck, pa.binary()), pa.array(members, pa.binary())], ["ck", "members"])

    def judge(batches):
        for b in batches:
            keep = []
            for x, y in zip(b["mu"], b["mv"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["u"].filter(keep), b["v"].filter(keep)], ["u", "v"])

    found = written(docs.select("text").mapInArrow(lean(sets), "ck binary, members binary").join(wanted, "ck", "left_semi").dropDuplicates(["ck"]), "sets")
    side = lambda node, name: found.select(F.col("ck").alias(node), F.col("members").alias(name))
    both = pairs.join(side("u", "mu"), "u").join(side("v", "mv"), "v")
    out = written(both.mapInArrow(lean(judge), "u binary, v binary"), "links")
    forget(pairs)
    forget(found)
    return out


def _linked(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The records of ``docs`` (id, text and what else is to be carried), and (node, root) of the set keys that link."""
    recs = written(_records(docs, k, num, den), "records")
    posts = _postings(recs, num, den)

    # Each posting list against its first member.
    whole = ("ck", "n", "pos", "l", "s0", "s1", "s2", "s3")
    head = posts.groupBy("tok").agg(F.min(F.struct("pos", "ck", "n", "l", "s0", "s1", "s2", "s3")).alias("h")).select("tok", *(F.col(f"h.{c}").alias(c) for c in whole))
    near = head.alias("a").join(posts.alias("b"), F.expr(f"a.tok = b.tok and a.ck != b.ck and {_close('a', 'b', num, den)}"))
    found = (F.least("a.ck", "b.ck").alias("u"), F.greatest("a.ck", "b.ck").alias("v"), F.least("a.l", "b.l").alias("l"), "w")
    links = _verified(docs, _shared(near.select(*found)), k, num, den)
    comp = written(components(links), "comp")

    # What still lies apart: every pair of one posting list, in both orders of component.
    label = F.coalesce("root", "ck").alias("c")
    named = posts.join(comp.select(F.col("node").alias("ck"), "root"), "ck", "left").select("tok", "w", *whole, label)
    salts = named.groupBy("tok").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("tok", "salts")
    mixed = written(named.join(salts, "tok"), "mixed")
    left = mixed.withColumn("salt", F.pmod(F.hash("ck"), "salts"))
    right = mixed.drop("w").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    apart = left.alias("a").join(right.alias("b"), F.expr(f"a.tok = b.tok and a.salt = b.salt and a.ck < b.ck and a.c != b.c and {_close('a', 'b', num, den)}"))
    more = _verified(docs, _shared(apart.select(*found)), k, num, den)
    for x in (posts, mixed):
        forget(x)
    if more.isEmpty():
        return recs, comp
    return recs, components(links.unionByName(more))


def jaccard_groups(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (8, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, and members, the number of rows of its component.

    A document's set holds its distinct ``k``-word shingles (A-Z lower-cased);
    a text of fewer words is one shingle, a null or blank text has an empty set
    and is a component of its own. Two documents link when their sets' Jaccard
    similarity is ``threshold[0] / threshold[1]`` or more. component_id is the
    least id of the component (null only if all its ids are null). Repeated
    rows and repeated ids each give a row; other columns are ignored.
    """
    num, den = threshold
    tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    recs, comp = _linked(docs, k, num, den)
    classes = recs.groupBy("ck").agg(F.min("id").alias("least"), F.count("*").alias("rows")).where(F.col("ck") != F.lit(_key(np.zeros(0, np.uint64))))
    roots = classes.join(comp.select(F.col("node").alias("ck"), "root"), "ck", "left").select("ck", "least", "rows", F.coalesce("root", "ck").alias("root"))
    best = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("members"))
    named = roots.select("ck", "root").join(best, "root").drop("root")
    return recs.select("id", "n", "ck").join(named, "ck", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("members"),
    )


def drop_near_copies(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """``docs`` with one document of each component: the first by doc_id (null last), set key and text hash.

    Of rows with that id and text, the one whose other columns come first.
    Documents without words stay, each row of them. Rows of one id or of none
    stay as long as they lie in different components. Columns and their order
    stay. Texts move only where a row is a copy or has the hash cell of one.
    """
    spark = docs.sparkSession
    tune(spark)
    # 128 bits of id and text; no id has a colon
    name = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))))
    recs, comp = _linked(docs.select(F.col("doc_id").cast("long").alias("id"), "text", name.alias("name")), k, *threshold)
    first = lambda *c: F.min(F.struct(F.col("id").isNull().alias("none"), "id", *c)).alias("f")
    worded = recs.where("n > 0")
    classes = worded.groupBy("ck").agg(first("name")).select("ck", "f.id", "f.name")
    roots = classes.join(comp.select(F.col("node").alias("ck"), "root"), "ck", "left").withColumn("root", F.coalesce("root", "ck"))
    firsts = written(roots.groupBy("root").agg(first("ck", "name")).select(F.col("f.name").alias("name"), F.lit(True).alias("stays")), "firsts")
    # all other rows are the only ones of their name and stay
    doubtful = written(worded.groupBy("name").agg(F.count("*").alias("rows")).join(firsts, "name", "left").where("stays is null or rows > 1").select("name", "stays"), "doubtful")
    forget(recs)
    cell = lambda c: F.conv(F.hex(F.substring(c, 1, 3)), 16, 10).cast("long")
    bits = spark.sparkContext.broadcast(bitmap_of(doubtful.select(cell("name").alias("cell")), "cell", 24))

    def marked(batches):
        for b in batches:
            yield b.set_column(b.schema.get_field_index("__doubt"), "__doubt", pa.array(in_bitmap(bits.value, b["__cell"].fill_null(0).to_numpy())))

    rows = docs.withColumn("__name", name).withColumn("__cell", cell("__name")).withColumn("__doubt", F.lit(True))
    rows = rows.mapInArrow(lean(marked), rows.schema).withColumn("__doubt", F.col("__doubt") & F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False)))
    clear = rows.where("not __doubt").select(*docs.columns)
    told = rows.where("__doubt").join(doubtful.withColumnRenamed("name", "__name").withColumn("__of", F.lit(True)), "__name", "left")
    lone = told.where("__of is null").select(*docs.columns)
    kept = told.where("stays").groupBy("__name").agg(F.min(F.struct(*docs.columns)).alias("f")).select("f.*")
    return clear.unionByName(lone).unionByName(kept)
