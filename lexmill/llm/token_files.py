"""Token-id files: canonical length-limited Huffman codes over a whole corpus.

Format of a folder. ``codebook``: one Parquet row with the end id, the block
length, and arrays of ids and code lengths in canonical order (by length, then
id), from which all codes follow. ``shards``: Parquet rows, each one segment of
consecutive documents: their ids and token counts, the bit stream (each
document starts at a byte), and a bit offset for every block of ``BLOCK``
tokens, so that any block decodes on its own. ``part`` and ``seg`` order the
segments; ``before`` counts the tokens of the same part that precede one.

Ids are counted over all documents, so every id that occurs has a code of at
most ``LIMIT`` bits, or more where there are over ``2**LIMIT`` ids. Files are written by Spark's own writer: a task that is
lost and run again leaves one copy of its rows.
"""

from __future__ import annotations

import json
import os
import sys
import types
import uuid
import zlib
from array import array
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORKER_CACHE, forget, lean, scratch_dir, tune, written

LIMIT = 16
BLOCK = 256
SEGMENT_TOKENS = 1 << 20
#: Words whose ids a worker keeps.
CACHE_WORDS = 700_000
#: Runs of letters or punctuation in one call to the tokenizer.
JOINED = 200
#: Fixed values of the tokenizer's file format: its split pattern, and ASCII punctuation without the apostrophe, which that pattern treats apart.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PUNCTUATION = b'.,;:!?"()-'


def limit_for(n: int) -> int:
    """The longest code for ``n`` ids: ``LIMIT`` bits, or one more than they need at least. A decoding table reads up to 25 bits."""
    return max(LIMIT, (n - 1).bit_length() + 1) if n > 1 << LIMIT else LIMIT


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit in codes of {limit} bits")
    if n == 1:
        return np.ones(1, np.uint8)
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    # each level: the leaves merged with pairs of the level below; which entries are leaves is enough to count depths
    level, kinds = leaf, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        kinds.append(rank < n)
    depth = np.zeros(n, np.int64)
    take = 2 * n - 2
    for kind in reversed(kinds):
        leaves = int(kind[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.zeros(n, np.uint8)
    out[order] = depth
    return out


class Codebook:
    """Codes by id and the decoding table, which has an entry for each string of as many bits as the longest code or ``LIMIT``, from canonical (id, length) pairs."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.limit = max(LIMIT, int(self.lengths.max(initial=0)))
        width = 1 << (self.limit - self.lengths)  # table entries that begin with a code
        first = np.cumsum(width) - width
        top = int(self.ids.max()) + 1 if len(ids) else 1
        self.code, self.bits = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code[self.ids] = (first >> (self.limit - self.lengths)).astype(np.uint64)
        self.bits[self.ids] = self.lengths
        self.table = np.zeros(1 << self.limit, np.uint32)
        self.table[: int(width.sum())] = np.repeat((self.ids << 5 | self.lengths).astype(np.uint32), width)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
        """Bit streams of consecutive documents and, for each, the bit offsets of its blocks."""
        bits = self.bits[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        at = np.cumsum(bits) - bits
        total = np.concatenate([at, [bits.sum()]])
        n_bytes = -(-(total[ends] - total[starts]) // 8)
        byte0 = np.cumsum(n_bytes) - n_bytes
        at += np.repeat(byte0 * 8 - total[starts], sizes)
        word = at >> 5
        lane = self.code[ids] << (64 - (at & 31) - bits).astype(np.uint64)
        out = np.zeros(int(n_bytes.sum()) // 4 + 3, np.uint64)
        if len(ids):
            head = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[head]] += np.add.reduceat(lane >> np.uint64(32), head)
            out[word[head] + 1] += np.add.reduceat(lane & np.uint64(0xFFFFFFFF), head)
        raw = out.astype(">u4").tobytes()
        streams = [raw[a : a + n] for a, n in zip(byte0.tolist(), n_bytes.tolist(), strict=True)]
        marks = [at[a:b:BLOCK] - 8 * z for a, b, z in zip(starts.tolist(), ends.tolist(), byte0.tolist(), strict=True)]
        return streams, marks

    def decode(self, stream: np.ndarray, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """All ids of consecutive documents: every block is a lane, all lanes step together."""
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        nth = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        goes = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        count = np.minimum(np.repeat(sizes, blocks) - nth * BLOCK, BLOCK)
        b = np.concatenate([stream, np.zeros(4, np.uint8)]).astype(np.uint32)
        b = b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]
        mask = np.uint32((1 << self.limit) - 1)
        order = np.argsort(-count, kind="stable")
        at, goes, count = marks[order].astype(np.int64), goes[order], -count[order]
        out = np.zeros(int(sizes.sum()), np.uint32)
        for step in range(BLOCK):
            live = int(np.searchsorted(count, -step, "left"))
            if not live:
                break
            p = at[:live]
            e = self.table[b[p >> 3] >> (32 - self.limit - (p & 7)).astype(np.uint32) & mask]
            out[goes[:live] + step] = e >> np.uint32(5)
            at[:live] += e & np.uint32(31)
        return out


class _WordIds:
    """Token ids of texts. Every tokenizer of this kind splits at white space, so a text's ids are its words' ids in turn.

    Words are looked up in two generations of at most ``CACHE_WORDS`` each: the
    older one goes when the younger is full, and words still in use move over.

    A tokenizer with the split pattern ``LETTER_RUNS`` and a mark on each run's
    last id takes a run of letters and a run of punctuation after it one by
    one. New words of that form are put together from their runs, each encoded
    once, many to a call; the marks show where a run's ids end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok, self.young, self.old = Tokenizer.from_file(path), {}, {}
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        steps = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        mark = kind["model"].get("end_of_word_suffix")
        self.ends = None
        if mark and steps[0].get("pattern") == {"Regex": LETTER_RUNS}:
            vocabulary = self.tok.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(mark)]] = True

    def _each(self, words: list[bytes]) -> list[bytes]:
        got = self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in got]

    def _runs(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """Ids of runs that the tokenizer doesn't split."""
        out = {}
        groups = [runs[i : i + JOINED] for i in range(0, len(runs), JOINED)]
        for group, got in zip(groups, self.tok.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.uint32)
            cut = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cut) == len(group):
                raw = ids.tobytes()
                out.update(zip(group, map(raw.__getitem__, map(slice, [0, *cut[:-1]], cut)), strict=True))
            else:
                out.update(zip(group, self._each(group), strict=True))
        return out

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        if self.ends is None:
            return dict(zip(words, self._each(words), strict=True))
        # words of a run of letters and perhaps one of punctuation; the others go whole
        plain, bodies, tails, other = [], [], [], []
        for w in words:
            body = w.rstrip(PUNCTUATION)
            # some letters are letter and mark in lower case
            if body.isalpha() or not body.isascii() and body.decode().lower().isalpha():
                plain.append(w)
                bodies.append(body.lower())
                tails.append(w[len(body) :])
            else:
                other.append(w)
        ids = self._runs(list({*bodies, *tails} - {b""}))
        ids[b""] = b""
        out = dict(zip(plain, map(add, map(ids.__getitem__, bodies), map(ids.__getitem__, tails)), strict=True))
        out.update(zip(other, self._each(other), strict=True))
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Packed uint32 ids of each text."""
        split = [t.split() for t in texts]
        every = set()
        for words in split:
            every.update(words)
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        known, old = self.young, self.old
        every = every.difference(known)
        new = list(every.difference(old))
        known.update((w, old[w]) for w in every if w in old)
        if new:
            known.update(self._encode(new))
        return [b"".join(map(known.__getitem__, words)) for words in split]


def _worker_ids(path: str) -> _WordIds:
    """One cache for all tasks of a worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    store = sys.modules.setdefault(WORKER_CACHE, types.ModuleType(WORKER_CACHE))
    if getattr(store, "path", None) != path:
        store.path, store.ids = path, _WordIds(path)
    return store.ids


def _ids_of(column: pa.Array, path: str, end_id: int) -> list[bytes]:
    end = array("I", [end_id]).tobytes()
    texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column.cast(pa.large_binary())]
    return [x + end for x in _worker_ids(path)(texts)]


def _flat(ids: pa.Array, n: pa.Array) -> np.ndarray:
    """All ids of a batch; each row has two or four bytes an id."""
    parts = []
    for x, k in zip(ids, n.to_pylist(), strict=True):
        raw = x.as_buffer()
        parts.append(np.frombuffer(raw, np.uint16 if raw.size == 2 * k else np.uint32))
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def write_tokens(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty), append ``end_id``, and write the folder ``out_dir`` in ascending id order.

    The tokenizer must split at ASCII white space before anything else and drop
    it. Rows with a null id come first; rows of one id lie next to each other,
    by their bits. An empty table gives a folder without segments.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def tokenize(batches):
        for b in batches:
            ids = _ids_of(b["text"], tokenizer_path, end_id)
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            wide = np.frombuffer(b"".join(ids), np.uint32)
            # half-size ids wherever a batch's ids allow it
            small = bool(len(wide)) and int(wide.max()) < 1 << 16
            raw = wide.astype(np.uint16).tobytes() if small else wide.tobytes()
            ends = np.cumsum(sizes) * (2 if small else 4)
            cut = [raw[a:z] for a, z in zip(np.concatenate([[0], ends[:-1]]).tolist() if len(ends) else [], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(sizes), pa.array(cut, pa.binary())], ["id", "n", "ids"])

    # the one time that texts are tokenized; what follows reads ids
    plain = written(docs.mapInArrow(tokenize, "id long, n long, ids binary"), "ids")

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            more = np.bincount(_flat(b["ids"], b["n"]))
            if len(more) < len(total):
                total[: len(more)] += more
            else:
                more[: len(total)] += total
                total = more
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["token", "n"])

    counts = plain.select("ids", "n").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    token, n = counts["token"].to_numpy(), counts["n"].to_numpy()
    lengths = code_lengths(n, limit_for(len(n))) if len(n) else np.zeros(0, np.uint8)
    book = Codebook(token, lengths)
    row = [(end_id, BLOCK, book.ids.tolist(), book.lengths.tolist())]
    spark.createDataFrame(row, "end_id long, block int, ids array<long>, lengths array<long>").coalesce(1).write.parquet(f"{out_dir}/codebook")
    shared = spark.sparkContext.broadcast((book.ids, book.lengths))

    def encode(batches):
        book = Codebook(*shared.value)
        for b in batches:
            streams, marks = book.encode(_flat(b["ids"], b["n"]), b["n"].to_numpy())
            yield pa.RecordBatch.from_arrays([b["id"], b["n"], pa.array(streams, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], ["id", "n", "bits", "marks"])

    def segments(batches):
        from pyspark import TaskContext

        part, seg, before = TaskContext.get().partitionId(), 0, 0
        ids, sizes, bits, marks, held, offset = [], [], [], [], 0, 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int64()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(bits)], pa.binary()), pa.array([np.concatenate(marks)], pa.list_(pa.int64()))],
                ["part", "seg", "before", "n_tokens", "ids", "sizes", "bits", "marks"],
            )

        for b in batches:
            for i, n, raw, m in zip(b["id"].to_pylist(), b["n"].to_pylist(), b["bits"].to_pylist(), b["marks"], strict=True):
                ids.append(i)
                sizes.append(n)
                bits.append(raw)
                marks.append(m.values.to_numpy() + 8 * offset)
                held, offset = held + n, offset + len(raw)
                if held >= SEGMENT_TOKENS:
                    yield flush()
                    before, seg = before + held, seg + 1
                    ids, sizes, bits, marks, held, offset = [], [], [], [], 0, 0
        if ids:
            yield flush()

    coded = plain.mapInArrow(encode, "id long, n long, bits binary, marks array<long>").repartitionByRange("id").sortWithinPartitions("id", "n", "bits")
    coded.mapInArrow(segments, "part int, seg long, before long, n_tokens long, ids array<long>, sizes array<long>, bits binary, marks array<long>").write.option("compression", "none").parquet(f"{out_dir}/shards")
    forget(plain)


def read_tokens(spark: SparkSession, out_dir: str) -> DataFrame:
    """Decode a folder: id, start (tokens of all rows before it), n_tokens, tokens (packed little-endian uint32)."""
    return _decoded(spark, out_dir, "tokens binary", lambda x: x)


def token_digests(spark: SparkSession, out_dir: str, last: bool = False) -> DataFrame:
    """As ``read_tokens``, with the crc32 of the packed tokens in their place. ``last``: no more texts are to be tokenized, and workers drop their words."""
    return _decoded(spark, out_dir, "ids_crc32 long", zlib.crc32, last)


def _decoded(spark: SparkSession, out_dir: str, column: str, digest, last: bool = False) -> DataFrame:
    head = spark.read.parquet(f"{out_dir}/codebook").first()
    shared = spark.sparkContext.broadcast((np.array(head["ids"], np.int64), np.array(head["lengths"], np.int64)))
    shards = spark.read.schema("part int, seg long, before long, n_tokens long, ids array<long>, sizes array<long>, bits binary, marks array<long>").parquet(f"{out_dir}/shards")
    # one number for each write task: as many as the folder has parts
    parts = dict(shards.groupBy("part").agg(F.sum("n_tokens")).toArrow().to_pandas().itertuples(index=False, name=None))
    base, at = {}, 0
    for p in sorted(parts):
        base[p], at = at, at + int(parts[p])
    name, kind = column.split()

    def decode(batches):
        book = Codebook(*shared.value)
        for b in batches:
            for part, before, ids, sizes, bits, marks in zip(b["part"].to_pylist(), b["before"].to_pylist(), b["ids"], b["sizes"], b["bits"], b["marks"], strict=True):
                sizes = sizes.values.to_numpy()
                out = book.decode(np.frombuffer(bits.as_buffer(), np.uint8), marks.values.to_numpy(), sizes)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                made = [digest(out[a:z].tobytes()) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(starts + before + base[part]), pa.array(sizes), pa.array(made, pa.binary() if kind == "binary" else pa.int64())], ["id", "start", "n_tokens", name])

    return shards.select("part", "before", "ids", "sizes", "bits", "marks").mapInArrow(lean(decode) if last else decode, f"id long, start long, n_tokens long, {column}")


def fresh_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/lexmill/tokens-{uuid.uuid4().hex}"
