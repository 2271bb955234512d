"""Model-input plans: packing, mask eligibility, masking, exposure, schedules.

Packing carries one number from row to row, the free slot, and lays out whole
blocks with arrays. Everything else is column expressions: masks come from a
table of hash words per sequence, schedules from prefix sums over buckets of
the permutation's digests, so that no task holds a whole condition.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import json_text

BLOCK = ("condition", "split", "source", "component", "document_id", "conversation_id", "span_id", "language_shard")
_STRUCT = "struct<row_id:string,row_order:int,row_tokens:int,source_start:int,source_end:int,packed_start:int,packed_end:int>"
PACKED = ", ".join(f"{c} string" for c in BLOCK) + f", local_index int, input_ids array<int>, attention_mask array<int>, provenance array<{_STRUCT}>"

# Protocol names that digests are made of.
MASK_PROTOCOL = "neu_mlm_masking_v1"
VALIDATION_PROTOCOL = "neu_fixed_validation_masks_v1"
SCHEDULE_PROTOCOL = "neu_option2_population_passes_v1"
BINDING_PROTOCOL = "neu_option2_packed_sequence_binding_v1"
ANCHOR_PROTOCOL = "neu_option2_condition_population_anchor_v1"
_POLICY_JSON = (
    '{"mask_fraction":0.8,"probability":0.15,"random_fraction":0.1,"special_token_ids":[0,1,2,3,4],'
    f'"unchanged_fraction":0.1,"vocabulary_size":{V.VOCABULARY}}}'
)


# --- packing ----------------------------------------------------------------


def layout(orders: np.ndarray, sizes: np.ndarray, length: int = V.LENGTH) -> pd.DataFrame:
    """Where the rows of one block go: (row, sequence, source_start, source_end, packed_start, packed_end) of every piece.

    A row continues in the slots that the one before left free, if its order
    follows; each piece takes a slot more for its separator, and a piece has a
    token at least. Of a row with t tokens the first piece takes what fits and
    the others a sequence each.
    """
    orders, sizes = np.asarray(orders, np.int64), np.asarray(sizes, np.int64)
    if (np.diff(orders) <= 0).any():
        raise ValueError("row order is not strictly increasing")
    whole = length - 2
    first_slot, first_size, sequence = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    slot, at = 1, 0
    for r, (gap, t) in enumerate(zip(np.diff(orders, prepend=orders[:1] - 1) > 1, sizes.tolist(), strict=True)):
        if slot > 1 and (gap or t and slot > whole):
            slot, at = 1, at + 1
        first_slot[r], sequence[r] = slot, at
        if t:
            first_size[r] = fit = min(t, length - 1 - slot)
            more = -(-(t - fit) // whole)
            slot, at = (slot + fit + 1, at) if not more else (t - fit - (more - 1) * whole + 2, at + more)
    pieces = np.where(sizes > 0, 1 - (first_size - sizes) // whole, 0)
    row = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.where(nth == 0, 0, first_size[row] + (nth - 1) * whole)
    end = np.where(nth == 0, first_size[row], np.minimum(sizes[row], start + whole))
    packed = np.where(nth == 0, first_slot[row], 1)
    return pd.DataFrame({"row": row, "sequence": sequence[row] + nth, "source_start": start, "source_end": end, "packed_start": packed, "packed_end": packed + end - start})


def pack_block(rows, length: int = V.LENGTH) -> list[tuple[list[int], list[int], list[tuple]]]:
    """(input ids, attention, pieces) of the sequences of one block's rows (row_id, row_order, token_ids) in order."""
    rows = list(rows)
    at = layout([r[1] for r in rows], [len(r[2]) for r in rows], length)
    if not len(at):
        return []
    seq, size = at["sequence"].to_numpy(), (at["source_end"] - at["source_start"]).to_numpy()
    n = int(seq[-1]) + 1
    tokens = np.concatenate([np.asarray(r[2], np.int64) for r in rows])
    grid = np.full((n, length), V.PAD)
    grid[:, 0] = V.CLS
    grid[np.repeat(seq, size), np.arange(len(tokens)) + np.repeat(at["packed_start"].to_numpy() - np.cumsum(size) + size, size)] = tokens
    grid[seq, at["packed_end"]] = V.SEP
    used = at.groupby("sequence")["packed_end"].max().to_numpy() + 1
    attention = (np.arange(length) < used[:, None]).astype(int)
    spans: list[list[tuple]] = [[] for _ in range(n)]
    for r, s, *places in at.itertuples(index=False):
        spans[s].append((rows[r][0], rows[r][1], len(rows[r][2]), *places))
    return list(zip(grid.tolist(), attention.tolist(), spans, strict=True))


def pack_rows(rows: DataFrame, length: int = V.LENGTH) -> DataFrame:
    """Q1, Q2: packed sequences with attention, provenance, ``sequence_index`` and identity.

    Columns of ``rows``: ``BLOCK``, row_id, row_order, token_ids. A condition's
    split is numbered from 0, its blocks in order of their keys.
    """
    names = ("row_id", "row_order", "row_tokens", "source_start", "source_end", "packed_start", "packed_end")
    columns = [*BLOCK, "local_index", "input_ids", "attention_mask", "provenance"]

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_order", kind="stable")
        key = {c: part[c].iloc[0] for c in BLOCK}
        made = pack_block(zip(part["row_id"], part["row_order"].tolist(), part["token_ids"], strict=True), length)
        return pd.DataFrame([{**key, "local_index": i, "input_ids": ids, "attention_mask": on, "provenance": [dict(zip(names, s, strict=True)) for s in spans]} for i, (ids, on, spans) in enumerate(made)], columns=columns)

    x = rows.groupBy(*BLOCK).applyInPandas(work, PACKED)
    # one narrow row a block
    own = Window.partitionBy("condition", "split").orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = x.groupBy(*BLOCK).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(own), F.lit(0))).drop("n")
    same = F.lit(True)
    for c in BLOCK:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    x = x.alias("a").join(starts.alias("b"), same).select("a.*", (F.col("b.start") + F.col("a.local_index")).cast("int").alias("sequence_index"))
    return x.withColumn("example_identity", identity())


def _json(*items: Column) -> Column:
    """A canonical JSON array of ready JSON texts."""
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def _json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _digest(text: Column) -> Column:
    return F.sha2(F.concat(text, F.lit("\n")), 256)


def identity() -> Column:
    """The digest of a sequence's condition, split, index and provenance."""
    own = {c: json_text(F.col(c)) for c in BLOCK}

    def piece(p: Column) -> Column:
        number = lambda c: p[c].cast("string")
        return _json(
            own["source"], own["component"], own["condition"], own["split"], own["document_id"], own["conversation_id"], own["span_id"], json_text(p["row_id"]), number("row_order"), own["language_shard"],
            *(number(c) for c in ("row_tokens", "source_start", "source_end", "packed_start", "packed_end")),
        )

    return _digest(_json(own["condition"], own["split"], F.col("sequence_index").cast("string"), _json_list(F.transform("provenance", piece))))


def eligible_positions(ids: Column, mask: Column) -> Column:
    """Q4: attended and not special."""
    return F.zip_with(ids, mask, lambda t, a: (a == 1) & ~t.isin(V.PAD, V.UNK, V.CLS, V.SEP, V.MASK))


def eligible_count(ids: Column, mask: Column) -> Column:
    return F.size(F.filter(eligible_positions(ids, mask), lambda x: x))


def packed_violations(x: DataFrame, length: int = V.LENGTH) -> DataFrame:
    """Q3: (example_identity, rule)."""
    n = F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v)
    rules = {
        "length": (F.size("input_ids") != length) | (F.size("attention_mask") != length), "start": F.col("input_ids")[0] != V.CLS, "end": F.element_at("input_ids", n) != V.SEP,
        "padding": F.exists(F.slice("input_ids", n + 1, F.lit(length)), lambda t: t != V.PAD), "vocabulary": F.exists("input_ids", lambda t: (t < 0) | (t >= V.VOCABULARY) | (t == V.MASK)),
        "separators": F.size(F.filter("input_ids", lambda t: t == V.SEP)) != F.size("provenance"),
    }
    return x.select("example_identity", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))


# --- masking ----------------------------------------------------------------


def _threshold(share: float) -> str:
    """The least 64-bit word, in hex, whose share of 2**64 as a double isn't below ``share``."""
    low = math.ceil(share * 2**64)
    while (low - 1) / 2**64 >= share:
        low -= 1
    return f"{low:016x}"


def masks(ids: Column, attention: Column, example: Column, seed: int, mode: str, visit: Column | None) -> Column:
    """Q5: struct of the places chosen, their kinds and their new ids, for one sequence.

    Word i of a sequence is the first 64 bits of SHA-256 over its key and i; an
    unsigned word's hex orders as the word does. A place takes one word to be
    chosen or not, a chosen one a second for its kind, a random id a third.
    """
    key = F.unhex(_digest(_json(F.lit(f'"{MASK_PROTOCOL}"'), F.lit(f'"{mode}"'), F.lit(str(seed)), json_text(example), *([] if visit is None else [visit.cast("string")]))))
    places = F.filter(F.transform(eligible_positions(ids, attention), lambda ok, i: F.when(ok, i)), lambda i: i.isNotNull())
    words = F.transform(F.sequence(F.lit(0), 3 * F.size(places) + 8), lambda i: F.substring(F.sha2(F.concat(key, F.unhex(F.lpad(F.hex(i.cast("long")), 32, "0"))), 256), 1, 16))
    bound = V.VOCABULARY - 5
    fair = f"{2**64 - 2**64 % bound:016x}"  # words from here on would favour small ids
    return F.struct(places.alias("places"), words.alias("words"), F.lit(_threshold(0.15)).alias("chosen"), F.lit(_threshold(0.80)).alias("masked"), F.lit(_threshold(0.80 + 0.10)).alias("random"), F.lit(fair).alias("fair"))


_WALK = f"""aggregate(m.places,
  named_struct('i', 0, 'at', cast(array() as array<int>), 'kinds', cast(array() as array<string>), 'ids', cast(array() as array<int>)),
  (a, p) -> case when m.words[a.i] >= m.chosen then named_struct('i', a.i + 1, 'at', a.at, 'kinds', a.kinds, 'ids', a.ids)
    when m.words[a.i + 1] < m.masked then named_struct('i', a.i + 2, 'at', array_append(a.at, p), 'kinds', array_append(a.kinds, 'mask'), 'ids', array_append(a.ids, {V.MASK}))
    when m.words[a.i + 1] >= m.random then named_struct('i', a.i + 2, 'at', array_append(a.at, p), 'kinds', array_append(a.kinds, 'unchanged'), 'ids', array_append(a.ids, input_ids[p]))
    else aggregate(slice(m.words, a.i + 3, 4), named_struct('i', a.i + 2, 'id', cast(null as int)),
      (z, w) -> case when z.id is not null then z when w < m.fair then named_struct('i', z.i + 1, 'id', cast(cast(conv(w, 16, 10) as decimal(20, 0)) % {V.VOCABULARY - 5} as int) + 5) else named_struct('i', z.i + 1, 'id', z.id) end,
      z -> named_struct('i', z.i, 'at', array_append(a.at, p), 'kinds', array_append(a.kinds, 'random'), 'ids', array_append(a.ids, z.id))) end)"""


def mask_sequences(x: DataFrame, seed: int, mode: str = "validation", visit: str | None = None) -> DataFrame:
    """Q5: masked_ids, labels, selected_positions, replacement_kinds and checksum of every row; ``visit`` names a column for training."""
    if (mode == "train") != (visit is not None):
        raise ValueError("training masks need a visit, validation masks take none")
    nth = None if visit is None else F.col(visit)
    y = x.withColumn("m", masks(F.col("input_ids"), F.col("attention_mask"), F.col("example_identity"), seed, mode, nth)).withColumn("w", F.expr(_WALK))
    y = y.withColumn("masked_ids", F.transform("input_ids", lambda t, i: F.coalesce(F.get(F.col("w.ids"), (F.array_position(F.col("w.at"), i) - 1).cast("int")), t)))
    y = y.withColumn("labels", F.transform("input_ids", lambda t, i: F.when(F.array_contains(F.col("w.at"), i), t).otherwise(-100)))
    y = y.withColumn("selected_positions", F.col("w.at")).withColumn("replacement_kinds", F.col("w.kinds")).drop("m", "w")
    numbers = lambda c: F.to_json(F.col(c))
    payload = F.concat(
        F.lit('{"attention_mask":'), numbers("attention_mask"), F.lit(',"example_identity":'), json_text(F.col("example_identity")), F.lit(',"input_ids":'), numbers("masked_ids"), F.lit(',"labels":'), numbers("labels"),
        F.lit(f',"mode":"{mode}","policy":{_POLICY_JSON},"seed":{seed},"token_type_ids":'), F.to_json(F.array_repeat(F.lit(0), F.size("input_ids"))), F.lit(',"visit":'), F.lit("null") if nth is None else nth.cast("string"), F.lit("}"),
    )
    return y.withColumn("checksum_sha256", _digest(payload))


def validation_record(x: DataFrame, seed: int) -> DataFrame:
    """Q6: per condition the number of validation examples and the checksum over their masks in order of ``sequence_index``.

    Rows of another split, and repeated identities, raise. The texts of one
    condition's masks meet in one row, as the checksum runs over all of them.
    """
    y = mask_sequences(x.withColumn("__bad", F.when(F.col("split") != "validation", F.raise_error(F.lit("validation masks take validation examples only")))), seed)
    example = F.concat(
        F.lit('{"attention_mask":'), F.to_json("attention_mask"), F.lit(',"example_identity":'), json_text(F.col("example_identity")), F.lit(',"labels":'), F.to_json("labels"),
        F.lit(',"masked_input_ids":'), F.to_json("masked_ids"), F.lit(',"token_type_ids":'), F.to_json(F.array_repeat(F.lit(0), F.size("input_ids"))), F.lit("}"),
    )
    items = F.array_sort(F.collect_list(F.struct(F.col("sequence_index").alias("i"), F.col("example_identity").alias("e"), example.alias("t"), F.col("__bad").alias("bad"))))
    z = y.groupBy("condition").agg(items.alias("items"))
    twice = F.size(F.array_distinct(F.col("items.e"))) < F.size("items")
    text = F.concat(F.lit('{"condition":'), json_text(F.col("condition")), F.lit(',"examples":'), _json_list(F.col("items.t")), F.lit(f',"policy":{_POLICY_JSON},"protocol":"{VALIDATION_PROTOCOL}","seed":{seed}}}'))
    return z.select("condition", F.lit(seed).alias("seed"), F.size("items").alias("example_count"), _digest(F.lit(_POLICY_JSON)).alias("policy_sha256"), F.when(twice, F.raise_error(F.lit("validation example identities must be unique"))).otherwise(_digest(text)).alias("checksum_sha256"))


def fixed_validation(x: DataFrame, seeds: dict[str, int]) -> DataFrame:
    """Q7: the validation record of every condition under every seed plan."""
    out = None
    for plan, seed in seeds.items():
        one = validation_record(x, seed).withColumn("plan", F.lit(plan))
        out = one if out is None else out.unionByName(one)
    return out


def exposure(x: DataFrame) -> DataFrame:
    """Per condition and split: sequences, wordpieces, padding and its share, eligible positions, and 0.15 of these."""
    n = F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v)
    y = x.select("condition", "split", n.alias("n"), F.size("input_ids").alias("all"), eligible_count(F.col("input_ids"), F.col("attention_mask")).alias("ok"))
    return y.groupBy("condition", "split").agg(
        F.count("*").alias("sequences"), F.sum("n").alias("wordpieces"), F.sum(F.col("all") - F.col("n")).alias("padding"),
        (F.sum(F.col("all") - F.col("n")) / F.sum("all")).alias("padding_fraction"), F.sum("ok").alias("eligible"), (F.sum("ok") * 0.15).alias("expected_targets"),
    )


# --- schedules --------------------------------------------------------------


def population_anchor(x: DataFrame, input_anchor: str) -> DataFrame:
    """Per condition the digest that binds its sequences, in order of ``sequence_index``: one digest a sequence meets in a row."""
    places = F.filter(F.transform(eligible_positions(F.col("input_ids"), F.col("attention_mask")), lambda ok, i: F.when(ok, i)), lambda i: i.isNotNull())
    index = F.col("sequence_index").cast("string")
    bound = _digest(_json(F.lit(f'"{BINDING_PROTOCOL}"'), json_text(F.col("condition")), index, F.to_json("input_ids"), F.to_json("attention_mask"), F.to_json(F.array_repeat(F.lit(0), F.size("input_ids"))), F.to_json(places)))
    row = _json(index, json_text(F.col("example_identity")), F.concat(F.lit('"'), bound, F.lit('"')))
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col("sequence_index").alias("i"), row.alias("t")))), lambda s: s["t"])
    text = _json(F.lit(f'"{ANCHOR_PROTOCOL}"'), F.lit(f'"{SCHEDULE_PROTOCOL}"'), F.lit(f'"{input_anchor}"'), json_text(F.col("condition")), _json_list(items))
    return x.groupBy("condition").agg(_digest(text).alias("population_anchor"))


def permutation_digest(group: Column, pass_index: Column, key: Column, input_anchor: str, population_anchor: Column) -> Column:
    """The digest whose order a pass over the population follows."""
    named = lambda name, c: _json(F.lit(f'"{name}"'), c)
    return _digest(_json(
        F.lit(f'"{SCHEDULE_PROTOCOL}"'), F.lit('"complete_population_permutation"'), named("input_population_anchor", F.lit(f'"{input_anchor}"')), named("condition_population_anchor", json_text(population_anchor)),
        named("condition", json_text(group)), named("zero_based_pass_index", pass_index.cast("string")), named("packed_sequence_identity", json_text(key)),
    ))


def schedule(items: DataFrame, target: int, passes: int, increment: int, group: str = "condition", key: str = "example_identity", weight: str = "eligible", index: str = "sequence_index", input_anchor: str = "", anchor: str | None = None, micro: int = 16) -> DataFrame:
    """Appearances in order, with pass, cursor, visit, update and microbatch.

    Whole passes, each in order of a digest (equal ones by ``index``), then one
    more until the cumulative weight reaches ``target``. With every weight
    below ``increment`` an update is the cumulative weight before, divided by
    the increment. A pass is cut into 256 buckets by its digests' first byte;
    places and weights are sums over earlier buckets and within one, so a task
    holds a 256th of a pass.
    """
    x = items.select(group, F.col(key).alias("key"), F.col(index).alias("index"), F.col(weight).cast("long").alias("w"), (F.lit("") if anchor is None else F.col(anchor)).alias("__anchor"))
    x = x.withColumn("pass_index", F.explode(F.sequence(F.lit(0), F.lit(passes))))
    x = x.withColumn("digest", permutation_digest(F.col(group), F.col("pass_index"), F.col("key"), input_anchor, F.col("__anchor"))).drop("__anchor").withColumn("bucket", F.substring("digest", 1, 2))
    sums = x.groupBy(group, "pass_index", "bucket").agg(F.count("*").alias("n"), F.sum("w").alias("z"))
    before = Window.partitionBy(group).orderBy("pass_index", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "pass_index", "bucket", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "z")))
    own = Window.partitionBy(group, "pass_index", "bucket").orderBy("digest", "index")
    x = x.join(sums, [group, "pass_index", "bucket"])
    x = x.withColumn("cursor", F.col("n0") + F.row_number().over(own) - 1).withColumn("before", F.col("z0") + F.coalesce(F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.where((F.col("pass_index") < passes) | (F.col("before") < target)).drop("n0", "z0", "bucket", "digest")
    # a sequence appears once a pass
    x = x.withColumn("visit", F.col("pass_index")).withColumn("update", F.floor(F.col("before") / increment) + 1)
    starts = x.groupBy(group, "update").agg(F.min("cursor").alias("start"))
    return x.join(starts, [group, "update"]).withColumn("microbatch", F.floor((F.col("cursor") - F.col("start")) / micro)).drop("start")


def update_plan(appearances: DataFrame, increment: int, group: str = "condition") -> DataFrame:
    """Per update: cursors, weight, cumulative weight, credit over the frontier, microbatches."""
    y = appearances.groupBy(group, "update").agg(F.min("cursor").alias("start"), (F.max("cursor") + 1).alias("end"), F.sum("w").alias("exposure"), (F.max("microbatch") + 1).alias("microbatches"), F.max(F.col("before") + F.col("w")).alias("cumulative"))
    return y.withColumn("token_credit", F.col("cumulative") - F.col("update") * increment)


def schedule_violations(expected: DataFrame, given: DataFrame, group: str = "condition") -> DataFrame:
    """Q11: the appearances in which a given schedule differs from the regenerated one; empty if they agree."""
    fields = ["key", "pass_index", "visit", "update", "microbatch", "w"]
    a, b = (x.select(group, "cursor", *(F.col(c).alias(f"{s}_{c}") for c in fields)) for x, s in ((expected, "a"), (given, "b")))
    differs = F.lit(False)
    for c in fields:
        differs |= ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return a.join(b, [group, "cursor"], "full_outer").where(differs).select(group, "cursor", F.when(F.col("a_key").isNull(), "extra").when(F.col("b_key").isNull(), "missing").otherwise("differs").alias("problem"))


def resume_points(plan: DataFrame, updates=(0, 250, 500, 750, 1000), group: str = "condition") -> DataFrame:
    """Q10: cursor, cumulative weight and credit at the end of each checkpoint's update; update 0 is the start."""
    zero = plan.select(group).distinct().select(group, F.lit(0).cast("long").alias("update"), *(F.lit(0).cast("long").alias(c) for c in ("cursor", "cumulative", "token_credit")))
    at = plan.where(F.col("update").isin(*[u for u in updates if u])).select(group, F.col("update").cast("long"), F.col("end").cast("long").alias("cursor"), F.col("cumulative").cast("long"), F.col("token_credit").cast("long"))
    return zero.unionByName(at) if 0 in updates else at


def selected_targets(appearances: DataFrame, sequences: DataFrame, seeds: dict[str, int], group: str = "condition") -> DataFrame:
    """Q9: masked targets per update, microbatch and seed plan, from the masks of each appearance's visit."""
    x = appearances.join(sequences.select(F.col("example_identity").alias("key"), group, "input_ids", "attention_mask"), [group, "key"]).withColumn("example_identity", F.col("key"))
    out = None
    for plan, seed in seeds.items():
        y = mask_sequences(x, seed, "train", "visit").groupBy(group, "update", "microbatch").agg(F.sum(F.size("selected_positions")).alias("targets")).withColumn("plan", F.lit(plan))
        out = y if out is None else out.unionByName(y)
    return out


def seed_audit(targets: DataFrame, group: str = "condition") -> DataFrame:
    """Per seed plan the conditions' targets, their least update, and whether their totals lie within one percent."""
    per = targets.groupBy("plan", group, "update").agg(F.sum("targets").alias("n")).groupBy("plan", group).agg(F.sum("n").alias("total"), F.min("n").alias("least"))
    return per.groupBy("plan").agg(
        F.count("*").alias("conditions"), F.min("total").alias("least_total"), F.max("total").alias("most_total"), F.min("least").alias("least_update"),
        ((F.min("least") > 0) & (100 * F.max("total") <= 101 * F.min("total"))).alias("pass"),
    )


def exposure_plan(appearances: DataFrame, group: str = "condition") -> DataFrame:
    """Per condition appearances, weight, updates, the range of update sizes and of repetitions, and mean repetition."""
    per = appearances.groupBy(group, "key").agg(F.count("*").alias("n")).groupBy(group).agg(F.count("*").alias("sequences"), F.min("n").alias("least_repeats"), F.max("n").alias("most_repeats"))
    ups = appearances.groupBy(group, "update").agg(F.count("*").alias("n"), F.sum("w").alias("w")).groupBy(group).agg(
        F.sum("n").alias("appearances"), F.sum("w").alias("exposure"), F.count("*").alias("updates"), F.min("n").alias("least_sequences"), F.max("n").alias("most_sequences"), F.min("w").alias("least_exposure"), F.max("w").alias("most_exposure"),
    )
    return per.join(ups, group).withColumn("mean_repeats", F.col("appearances") / F.col("sequences"))


def within_one_percent(values: DataFrame, value: str) -> DataFrame:
    """whether 100 * max <= 101 * min over positive whole numbers."""
    return values.agg((F.coalesce(F.min(value) > 0, F.lit(False)) & (100 * F.max(value) <= 101 * F.min(value))).alias("pass"))


def normalized_loss(microbatches: DataFrame, group: str = "update") -> DataFrame:
    """Sum of numerators over sum of targets; an update without targets raises."""
    n = F.sum("targets")
    return microbatches.groupBy(group).agg(F.when(n > 0, F.sum("numerator") / n).otherwise(F.raise_error(F.lit("an update has no targets"))).alias("loss"))


def learning_rates(spark: SparkSession, updates: int = 1000, warm: int = 100, peak: float = 1e-4) -> DataFrame:
    u = F.col("update")
    return spark.range(1, updates + 1).withColumnRenamed("id", "update").select("update", F.when(u <= warm, peak * u / warm).otherwise(peak * (updates + 1 - u) / (updates - warm)).alias("rate"))
