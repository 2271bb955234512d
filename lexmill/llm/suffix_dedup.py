"""Removal of repeated byte strings by suffix arrays over shards.

Every ``SPAN``-byte string picks an anchor: the ``GRAM``-byte string inside it
with the least hash (the rightmost of equal ones). Equal strings pick equal
anchors at equal places, so two copies always meet under their anchor's hash.
An anchor that occurs once in the corpus ends there. Around each occurrence of
another lies a segment, all ``SPAN``-byte strings that can have picked it.
Segments travel as references (text, start, two 64-bit hashes of their bytes);
of those that differ under one anchor, one of each kind gets its bytes. Whole
anchors go to shards. There segments are cut to what they can share at most and
equal ones merged, then joined to one text and sorted by induced sorting, and
the permuted common prefixes show the strings that occur in two segments of an
anchor at the same place.

An anchor whose kinds would overfill a shard is halved: the strings that start
in the left half of places around it, and those in the right half, have a
longer string in common, whose hash is a new anchor. So every anchor of any
size ends in shards of bounded size, after at most eight halvings.

Equal texts are handled once: of two or more all strings are repeated.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bitmap_of, forget, in_bitmap, mix, powers, prefix_hash, released, span_hash, text_bytes, tune, written
from .suffix_sort import permuted_prefixes, suffix_array

SPAN = 200
GRAM = 64
#: Bytes of one sorted text; also of the kinds of an anchor before it is halved.
SHARD_BYTES = 1 << 20
#: Bytes of text that are scanned at once; longer texts are cut into windows of it.
WINDOW = 1 << 19
COPY_BITS = 24
ANCHOR_BITS = 25


def _settle(spark) -> None:
    """Let Spark drop the shuffle files of queries that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SECOND = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _second_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SECOND[data] * powers(len(data)), out=out[1:], dtype=np.uint64)
    return out


def anchors(data: np.ndarray, starts: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors that strings from the marked ``starts`` pick."""
    width = span - gram + 1
    m = len(data) - gram + 1
    if m < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_hash(data)
    h = mix((sums[gram:] - sums[:-gram]) * powers(len(sums), True)[:m])
    key = h & np.uint64(0xFFFFFFFF00000000) | (np.uint64(0xFFFFFFFF) - np.arange(m, dtype=np.uint64))
    rows = -(-m // width)
    grid = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[:m] = key
    grid = grid.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = m - width + 1
    least = np.minimum(right[:n], left[width - 1 : width - 1 + n])[starts[:n]]
    least = np.unique(least[np.concatenate([[True], least[1:] != least[:-1]])]) if len(least) else least
    pos = np.sort((np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64))
    return pos, h[pos]


def _windows(size: np.ndarray, span: int, step: int):
    """Groups of (text, first string, end of strings, from, to): whole texts, or windows of long ones with what their segments need."""
    held, n = [], 0
    for r, z in enumerate(size.tolist()):
        for a in range(0, z - span + 1, step):
            b = min(a + step, z - span + 1)
            lo, hi = max(0, a - span), min(z, b + 2 * span)
            if held and n + hi - lo > step:
                yield held
                held, n = [], 0
            held.append((r, a, b, lo, hi))
            n += hi - lo
    if held:
        yield held


def found_anchors(data: np.ndarray, off: np.ndarray, span: int = SPAN, gram: int = GRAM, step: int = WINDOW, wanted=None):
    """Yield (text, position, hash, segment start, segment size, two segment hashes) as arrays, each anchor once."""
    border: dict[int, np.ndarray] = {}  # of a text whose windows go on
    for group in _windows(np.diff(off), span, step):
        part = np.concatenate([data[off[r] + lo : off[r] + hi] for r, _, _, lo, hi in group])
        base = np.cumsum([0] + [hi - lo for _, _, _, lo, hi in group])
        starts = np.zeros(len(part), bool)
        for (_, a, b, lo, _), at in zip(group, base, strict=False):
            starts[at + a - lo : at + b - lo] = True
        pos, h = anchors(part, starts, span, gram)
        which = np.searchsorted(base, pos, "right") - 1
        row, _, _, lo, hi = (np.array(x, np.int64) for x in zip(*group, strict=True))
        place = pos - base[which] + lo[which]
        new = np.ones(len(pos), bool)
        for g, (r, a, b, _, _) in enumerate(group):
            if a:
                own = np.flatnonzero(which == g)
                new[own] = ~np.isin(place[own], border.get(r, ()))
            if b < off[r + 1] - off[r] - span + 1:
                border = {r: place[which == g]}
        if wanted is not None:
            new &= wanted(h)
        pos, h, which, place = pos[new], h[new], which[new], place[new]
        begin = np.maximum(pos + gram - span, base[which])
        end = np.minimum(pos + span, base[which + 1])
        tag = mix(((place - lo[which] + base[which] - begin) * np.int64(1 << 20) + (end - begin)).view(np.uint64) ^ h)
        one = span_hash(prefix_hash(part), begin, end) ^ tag
        two = span_hash(_second_sums(part), begin, end) + tag
        yield row[which], place, h, begin - base[which] + lo[which], end - begin, one, two


def _covered(starts: np.ndarray, span: int) -> np.ndarray:
    """Merged [from, to) runs, flat, of strings that start at ascending ``starts``."""
    if not len(starts):
        return np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(starts) > span)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + span], axis=1).reshape(-1)


def _longest_shared(anchor: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """For each part its longest common prefix with another part of the same anchor: the neighbours in sorted order have it."""
    n = len(parts)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order = np.array(sorted(range(n), key=lambda i: (anchor[i], parts[i])))
    size = np.array([len(parts[i]) for i in order])
    width = int(size.max(initial=0))
    if not width:
        return out
    grid = np.frombuffer(b"".join(parts[i].ljust(width, b"\0") for i in order), np.uint8).reshape(n, width)
    differs = grid[1:] != grid[:-1]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    same = np.where(anchor[order[1:]] == anchor[order[:-1]], np.minimum(first, np.minimum(size[1:], size[:-1])), 0)
    both = np.maximum(np.append(same, 0), np.insert(same, 0, 0))
    out[order] = both
    return out


def shard_repeats(anchor: np.ndarray, lead: np.ndarray, core: np.ndarray, bodies: list[bytes], often: np.ndarray, span: int = SPAN) -> list[np.ndarray]:
    """For each segment of a shard, the starts of its strings that occur twice under its anchor at the same place.

    ``core`` is the length of what all segments of the anchor have in common at
    ``lead``; ``often`` says how often the segment occurs.
    """
    left = _longest_shared(anchor, [b[z - 1 :: -1] if z else b"" for b, z in zip(bodies, lead.tolist(), strict=True)])
    right = _longest_shared(anchor, [b[z:] for b, z in zip(bodies, (lead + core).tolist(), strict=True)])
    cut, end = lead - left, lead + core + right
    out = [np.zeros(0, np.int64)] * len(bodies)
    merged: dict[tuple[int, int, bytes], int] = {}
    number: list[int] = []
    kept = np.flatnonzero((end - cut >= span) & (often < 2)).tolist()
    # what occurs twice is repeated as it is, and stands in the text whole, as a partner of the others
    other = np.flatnonzero(often > 1).tolist()
    for i in other:
        out[i] = np.arange(len(bodies[i]) - span + 1)
    spans = [(i, int(cut[i]), int(end[i])) for i in kept] + [(i, 0, len(bodies[i])) for i in other]
    for i, a, z in spans:
        number.append(merged.setdefault((int(anchor[i]), int(lead[i]) - a, bodies[i][a:z]), len(merged)))
    if kept:
        weight = np.zeros(len(merged), np.int64)
        np.add.at(weight, number, often[[i for i, _, _ in spans]])
        keys = list(merged)
        found = _aligned_repeats(np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64), [k[2] for k in keys], weight, span)
        for (i, a, _), k in zip(spans[: len(kept)], number, strict=False):
            out[i] = found[k] + a
    return out


def _aligned_repeats(anchor: np.ndarray, lead: np.ndarray, bodies: list[bytes], weight: np.ndarray, span: int) -> list[np.ndarray]:
    """The starts of the strings of each body that occur twice, by a suffix array over the bodies; a body counts ``weight`` times."""
    size = np.array([len(b) for b in bodies], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    raw = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    owner = np.repeat(np.arange(len(bodies)), size + 1)
    t = raw.astype(np.int32) + 2
    t[begin + size] = 1
    t[-1] = 0
    sa = suffix_array(t, 258)
    plcp = permuted_prefixes(raw, sa, span)
    run = np.cumsum(plcp[sa] < span)
    seg = owner[sa]
    place = sa - begin[seg]
    valid = size[seg] - place >= span
    run, seg, place = run[valid], seg[valid], place[valid]
    _, which = np.unique(anchor, return_inverse=True)
    # strings of one run, anchor and place relative to the anchor
    rel = place - lead[seg]
    order = np.lexsort((rel, which[seg], run))
    run, seg, place, rel = run[order], seg[order], place[order], rel[order]
    own = which[seg]
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (own[1:] != own[:-1]) | (rel[1:] != rel[:-1])]) if len(run) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    twice = np.bincount(group, weight[seg], minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
    seg, place = seg[twice], place[twice]
    order = np.lexsort((place, seg))
    seg, place = seg[order], place[order]
    edge = np.searchsorted(seg, np.arange(len(bodies) + 1))
    return [place[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ck, text) with each text of ``SPAN`` bytes or more once, and (ck) of those that occur twice or more."""
    spark = docs.sparkSession
    rows = docs.select("ck", F.col("text")).where(F.octet_length("text") >= SPAN)
    copies = written(rows.groupBy("ck").agg(F.count("*").alias("n")).where("n > 1").select("ck"), "copies")
    cell = F.conv(F.hex(F.substring("ck", 1, 3)), 16, 10).cast("long")
    shared = spark.sparkContext.broadcast(bitmap_of(copies.select(cell.alias("cell")), "cell", COPY_BITS))

    def split(batches):
        sent = set()  # of a text's copies in one task one goes on
        for b in batches:
            keys = b["ck"].to_pylist()
            again = in_bitmap(shared.value, np.array([int.from_bytes(x[:3], "big") for x in keys], np.uint64))
            keep = np.ones(len(keys), bool)
            for i in np.flatnonzero(again).tolist():
                keep[i] = keys[i] not in sent
                sent.add(keys[i])
            yield b.append_column("again", pa.array(again)).filter(pa.array(keep))

    marked = rows.mapInArrow(split, "ck binary, text string, again boolean")
    once = written(marked.where("again").select("ck", "text").dropDuplicates(["ck"]), "once")
    return marked.where("not again").select("ck", "text").unionByName(once), copies


_REFERENCE = "h long, s1 long, s2 long, ck binary, start int, lead int, size int"


def _references(texts: DataFrame) -> DataFrame:
    """(h, s1, s2, ck, start, lead, size): a segment around each occurrence of an anchor that occurs twice or more, and few others."""

    def hashes(batches):
        for b in batches:
            data, off = text_bytes(b["text"])
            for _, _, h, *_ in found_anchors(data, off):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])
        released()

    mask = (1 << ANCHOR_BITS) - 1  # the low bits: anchors have small hashes
    again = texts.select("text").mapInArrow(hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    bits = texts.sparkSession.sparkContext.broadcast(bitmap_of(again.select(F.col("h").bitwiseAND(mask).alias("cell")), "cell", ANCHOR_BITS))

    def refer(batches):
        wanted = lambda h: in_bitmap(bits.value, h & np.uint64(mask))
        for b in batches:
            data, off = text_bytes(b["text"])
            for row, place, h, start, size, one, two in found_anchors(data, off, wanted=wanted):
                lead = (place - start).astype(np.int32)
                longs = (pa.array(x.view(np.int64)) for x in (h, one, two))
                yield pa.RecordBatch.from_arrays([*longs, b["ck"].take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (start, lead, size))], ["h", "s1", "s2", "ck", "start", "lead", "size"])
        released()

    return texts.mapInArrow(refer, _REFERENCE)


def _with_bodies(kinds: DataFrame, texts: DataFrame) -> DataFrame:
    """(k1, k2, key, n, lead, core, body) of ``kinds`` (s1, s2, h, n, lead, ck, start, size): a text is read once, where its kinds meet it."""
    at = kinds.groupBy("ck").agg(F.collect_list(F.struct("s1", "s2", "h", "n", "lead", "start", "size")).alias("at"))

    def cut(batches):
        for b in batches:
            data, off = text_bytes(b["text"])
            flat = b["at"].values.flatten()
            many = np.diff(b["at"].offsets.to_numpy())
            start = np.repeat(off[:-1], many) + flat[5].to_numpy()
            end = start + flat[6].to_numpy()
            body = [data[a:z].tobytes() for a, z in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([flat[0], flat[1], flat[2], flat[3], flat[4], pa.array(np.full(len(body), GRAM, np.int32)), pa.array(body, pa.binary())], _KIND_COLUMNS)
        released()

    return texts.join(at, "ck").select("text", "at").mapInArrow(cut, _KIND)


_KIND = "k1 long, k2 long, key long, n long, lead int, core int, body binary"
_KIND_COLUMNS = ["k1", "k2", "key", "n", "lead", "core", "body"]


def _sorted_repeats(kinds: DataFrame) -> DataFrame:
    """(k1, k2, runs) from suffix arrays: tasks read anchors in order and close a shard between two anchors."""

    def solve(batches):
        held, n = [], 0

        def close():
            k1, k2, key, often, lead, core, body = (np.concatenate(x) if i < 6 else [v for y in x for v in y] for i, x in enumerate(zip(*held, strict=True)))
            runs = [_covered(x, SPAN) for x in shard_repeats(key, lead, core, body, often)]
            some = [i for i, r in enumerate(runs) if len(r)]
            return pa.RecordBatch.from_arrays([pa.array(k1[some]), pa.array(k2[some]), pa.array([runs[i] for i in some], pa.list_(pa.int64()))], ["k1", "k2", "runs"])

        last = None
        for b in batches:
            cols = [b[c].to_numpy() for c in _KIND_COLUMNS[:4]] + [b[c].to_numpy().astype(np.int64) for c in ("lead", "core")]
            body = b["body"].to_pylist()
            key = cols[2]
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if n >= SHARD_BYTES and key[a] != last:
                    yield close()
                    held, n = [], 0
                held.append([c[a:z] for c in cols] + [body[a:z]])
                n += sum(map(len, body[a:z]))
                last = key[a]
        if held:
            yield close()
        released()

    return kinds.select(*_KIND_COLUMNS).repartition("key").sortWithinPartitions("key", "k1", "k2").mapInArrow(solve, "k1 long, k2 long, runs array<long>")


def halves(lead: int, core: int, size: int, span: int = SPAN):
    """(side, from, to, lead, core) of the two parts of a segment: strings that start in the left and the right half of places."""
    far = span - core
    mid = -(far // 2) - 1
    for side, first, last in ((0, -far, mid), (1, mid + 1, 0)):
        a, z = max(0, lead + first), min(size, lead + last + span)
        # from the last start to the end of the first string
        if first <= last and lead + last >= 0 and lead + first + span <= size and z - a >= span:
            yield side, a, z, lead + last - a, first + span - last


def _halved(kinds: DataFrame) -> DataFrame:
    """(k1, k2, at, n, j1, j2, key, lead, core, body): both parts of each kind; j1 and j2 are equal for equal parts."""

    def split(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(10)]
            for k1, k2, key, n, lead, core, body in zip(*(b[c].to_pylist() for c in _KIND_COLUMNS), strict=True):
                for side, a, z, to, held in halves(lead, core, len(body)):
                    part = body[a:z]
                    common = hashlib.blake2b(part[to : to + held], digest_size=8, key=f"{key} {side}".encode()).digest()
                    own = hashlib.blake2b(part, digest_size=16, key=common, salt=to.to_bytes(4, "big")).digest()
                    row = (k1, k2, a, n, *(int.from_bytes(x, "big", signed=True) for x in (own[:8], own[8:], common)), to, held, part)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds_ = [pa.int64()] * 2 + [pa.int32(), pa.int64()] + [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_, strict=True)], ["k1", "k2", "at", "n", "j1", "j2", "key", "lead", "core", "body"])

    return kinds.select(*_KIND_COLUMNS).mapInArrow(split, "k1 long, k2 long, at int, n long, j1 long, j2 long, key long, lead int, core int, body binary")


def _solved(kinds: DataFrame) -> DataFrame:
    """(k1, k2, runs) of written ``kinds`` that may share strings with others of their key."""
    sizes = written(kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.octet_length("body")).alias("bytes")).where(f"kinds > 1 and bytes > {SHARD_BYTES}").select("key"), "large")
    if sizes.isEmpty():
        return _sorted_repeats(kinds)
    parts = written(_halved(kinds.join(sizes, "key", "left_semi")), "halves")
    whole = parts.groupBy(F.col("j1").alias("k1"), F.col("j2").alias("k2")).agg(F.first("key").alias("key"), F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("lead", "core", "body")))
    below = _solved(written(whole.select(*_KIND_COLUMNS), "halved"))
    got = parts.select("k1", "k2", "at", "j1", "j2").join(below.withColumnsRenamed({"k1": "j1", "k2": "j2"}), ["j1", "j2"])
    got = got.select("k1", "k2", F.transform("runs", lambda x: x + F.col("at")).alias("runs")).groupBy("k1", "k2").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return _sorted_repeats(kinds.join(sizes, "key", "left_anti")).unionByName(got)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(ck, runs): for each distinct text (ck, 128 bits of its SHA-256) with repeated strings, byte runs [from, to) that cover them."""
    spark = docs.sparkSession
    texts, copies = _distinct_texts(docs)
    refs = written(_references(texts), "references")
    _settle(spark)
    # of the occurrences of one kind any will do, they have the same bytes
    kinds = written(refs.groupBy("h", "s1", "s2").agg(F.count("*").alias("n"), F.first("lead").alias("lead"), F.min(F.struct("ck", "start", "size")).alias("at")).select("h", "s1", "s2", "n", "lead", "at.*"), "kinds")
    counts = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    bodies = written(_with_bodies(kinds.join(counts, "h", "left_semi"), texts), "bodies")
    _settle(spark)
    alone = kinds.where("n > 1").join(counts, "h", "left_anti").select("s1", "s2", F.array(F.lit(0).cast("long"), F.col("size").cast("long")).alias("runs"))
    parts = written(alone.unionByName(_solved(bodies).withColumnsRenamed({"k1": "s1", "k2": "s2"})), "runs")
    _settle(spark)
    moved = F.transform("runs", lambda x: x + F.col("start"))
    own = refs.select("s1", "s2", "ck", "start").join(parts, ["s1", "s2"]).select("ck", moved.alias("runs"))
    own = own.groupBy("ck").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    every = copies.select("ck", F.array(F.lit(0).cast("long"), F.lit(2**31).cast("long")).alias("runs"))
    out = written(own.join(copies, "ck", "left_anti").unionByName(every), "repeats")
    for x in (refs, kinds, bodies, parts):
        forget(x)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and kept, the bytes that remain.

    A byte goes if a ``SPAN``-byte string that covers it starts anywhere else,
    judged on the input. A null text counts as empty and shorter texts stay
    whole. Repeated rows are copies of each other: both lose all their bytes.
    """
    spark = docs.sparkSession
    tune(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("ck"))
    runs = repeated_runs(docs)
    _settle(spark)

    def finish(batches):
        for b in batches:
            data, off = text_bytes(b["text"])
            n, gone, spans, sha, kept = [], [], [], [], []
            for r, x in enumerate(b["runs"]):
                raw = data[off[r] : off[r + 1]].tobytes()
                left = raw
                removed = count = 0
                if x.is_valid and len(x.values):
                    pairs = x.values.to_numpy().reshape(-1, 2)
                    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                    keep, at = [], 0
                    top = -1
                    for a, z in pairs.tolist():
                        z = min(z, len(raw))
                        if a > top:
                            keep.append(raw[at:a])
                            count += 1
                            removed += z - a
                            top = at = z
                        elif z > top:
                            removed += z - top
                            top = at = z
                    keep.append(raw[at:])
                    left = b"".join(keep)
                n.append(len(raw))
                gone.append(removed)
                spans.append(count)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([b["id"], *(pa.array(v, pa.int64()) for v in (n, gone, spans)), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        released()

    kind = docs.schema["id"].dataType.simpleString()
    out = docs.join(runs, "ck", "left").select("id", "text", "runs").mapInArrow(finish, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)
