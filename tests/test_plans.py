"""Packing, masks and schedules against plain statements of their rules."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lexmill import vocab as V
from lexmill.functions.text import json_text
from lexmill.plans import sequences as Q


def canonical(value) -> bytes:
    return (json.dumps(value, ensure_ascii=True, sort_keys=True, separators=(",", ":")) + "\n").encode()


def test_packing_small():
    [(ids, on, spans)] = Q.pack_block([("a", 0, [10, 11]), ("b", 1, [12])])
    assert ids == [2, 10, 11, 3, 12, 3] + [0] * 122 and sum(on) == 6 and [s[0] for s in spans] == ["a", "b"]
    assert [s[3:5] for _, _, spans in Q.pack_block([("a", 0, [9] * 300)]) for s in spans] == [(0, 126), (126, 252), (252, 300)]
    assert len(Q.pack_block([("a", 0, [9]), ("b", 2, [9])])) == 2 and Q.pack_block([("a", 0, [])]) == []
    with pytest.raises(ValueError):
        Q.pack_block([("a", 1, [9]), ("b", 1, [9])])


def test_packing_laws():
    draw = random.Random(5)
    for _ in range(300):
        rows = [(f"r{i}", i, [draw.randint(5, 99) for _ in range(draw.choice([0, 1, 2, 60, 124, 125, 126, 127, 300]))]) for i in range(draw.randint(1, 6))]
        made = Q.pack_block(rows)
        assert [t for ids, on, _ in made for t, m in zip(ids, on, strict=True) if m and t > 4] == [t for r in rows for t in r[2]]
        for k, (ids, on, spans) in enumerate(made):
            assert len(ids) == 128 and ids[0] == V.CLS and ids[sum(on) - 1] == V.SEP and ids.count(V.SEP) == len(spans)
            for row_id, _, n, a, z, p, e in spans:
                assert ids[p:e] == rows[int(row_id[1:])][2][a:z] and 0 <= a < z <= n
            # no slot is left that the next piece's first token and separator would fit in
            assert k == len(made) - 1 or sum(on) >= 127


def test_json_text(spark):
    cases = ['a"b\\c', "é😀\n\t\x1f\x7f", "", "plain ~", None, "日本\u2028"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(cases)), "i int, s string").orderBy("i").select(json_text(F.col("s"))).collect()]
    assert got == [json.dumps(s) for s in cases]


def masked(ids, on, example, seed, visit=None):
    """The rule in words: each attended ordinary token is chosen with 0.15, then masked with 0.8, random with 0.1, else left."""
    key = hashlib.sha256(canonical([Q.MASK_PROTOCOL, "validation" if visit is None else "train", seed, example] + ([] if visit is None else [visit]))).digest()
    words = (int.from_bytes(hashlib.sha256(key + i.to_bytes(16, "big")).digest()[:8], "big") for i in range(10**6))
    out, places = list(ids), []
    for p in [p for p, t in enumerate(ids) if on[p] and t > 4]:
        if next(words) / 2**64 < 0.15:
            places.append(p)
            share = next(words) / 2**64
            if share < 0.8:
                out[p] = V.MASK
            elif share < 0.8 + 0.1:
                top = 2**64 // (V.VOCABULARY - 5) * (V.VOCABULARY - 5)
                out[p] = next(w for w in words if w < top) % (V.VOCABULARY - 5) + 5
    return out, places


def sequences(spark, n=12):
    draw = random.Random(9)
    rows = [("c", "validation", "s", "k", "d", str(i), None, None, f"r{i}", 0, [draw.randint(5, 7999) for _ in range(draw.choice([1, 40, 126, 200]))]) for i in range(n)]
    kinds = ", ".join(f"{c} string" for c in Q.BLOCK)
    return Q.pack_rows(spark.createDataFrame(rows, f"{kinds}, row_id string, row_order int, token_ids array<int>"))


@pytest.mark.parametrize("visit", [None, 3])
def test_masks(spark, visit):
    x = sequences(spark).withColumn("visit", F.lit(visit).cast("int"))
    for r in Q.mask_sequences(x, 7, "validation" if visit is None else "train", None if visit is None else "visit").collect():
        out, places = masked(r.input_ids, r.attention_mask, r.example_identity, 7, visit)
        assert (r.masked_ids, r.selected_positions) == (out, places)
        assert r.labels == [t if p in places else -100 for p, t in enumerate(r.input_ids)]
        policy = {"probability": 0.15, "mask_fraction": 0.8, "random_fraction": 0.1, "unchanged_fraction": 0.1, "vocabulary_size": V.VOCABULARY, "special_token_ids": [0, 1, 2, 3, 4]}
        payload = {"attention_mask": r.attention_mask, "example_identity": r.example_identity, "input_ids": out, "labels": r.labels, "mode": "validation" if visit is None else "train", "policy": policy, "seed": 7, "token_type_ids": [0] * 128, "visit": visit}
        assert r.checksum_sha256 == hashlib.sha256(canonical(payload)).hexdigest()


def test_identity_and_validation_record(spark):
    x = sequences(spark)
    rows = x.orderBy("sequence_index").collect()
    assert [r.sequence_index for r in rows] == list(range(len(rows)))
    for r in rows:
        parts = [[r.source, r.component, r.condition, r.split, r.document_id, r.conversation_id, None, p.row_id, p.row_order, None, p.row_tokens, p.source_start, p.source_end, p.packed_start, p.packed_end] for p in r.provenance]
        assert r.example_identity == hashlib.sha256(canonical([r.condition, r.split, r.sequence_index, parts])).hexdigest()
    a, b = Q.validation_record(x, 7).first(), Q.validation_record(x, 8).first()
    assert a.example_count == len(rows) and a.checksum_sha256 == Q.validation_record(x, 7).first().checksum_sha256 != b.checksum_sha256 and a.policy_sha256 == b.policy_sha256
    assert {(r.plan, r.checksum_sha256) for r in Q.fixed_validation(x, {"one": 7, "two": 8}).collect()} == {("one", a.checksum_sha256), ("two", b.checksum_sha256)}
    with pytest.raises(Exception, match="identities must be unique"):
        Q.validation_record(x.unionByName(x), 7).collect()
    with pytest.raises(Exception, match="validation examples only"):
        Q.validation_record(x.withColumn("split", F.lit("train")), 7).collect()
    assert Q.packed_violations(x).count() == 0
    broken = x.withColumn("input_ids", F.transform("input_ids", lambda t, i: F.when(i == 0, 9).otherwise(t)))
    assert {r.rule for r in Q.packed_violations(broken).collect()} == {"start"}


def test_schedule(spark):
    x = spark.createDataFrame([("c", str(i), i, 10) for i in range(6)], "condition string, example_identity string, sequence_index int, eligible int")
    s = Q.schedule(x, target=150, passes=2, increment=25, micro=2, input_anchor="a" * 64)
    rows = s.orderBy("cursor").collect()
    name = lambda p, k: hashlib.sha256(canonical([Q.SCHEDULE_PROTOCOL, "complete_population_permutation", ["input_population_anchor", "a" * 64], ["condition_population_anchor", ""], ["condition", "c"], ["zero_based_pass_index", p], ["packed_sequence_identity", k]])).hexdigest()
    assert [(r.pass_index, r.key) for r in rows] == [(p, k) for p in range(3) for k in sorted(map(str, range(6)), key=lambda k: name(p, k))][:15]
    assert [r["update"] for r in rows] == [10 * i // 25 + 1 for i in range(15)] and [r.cursor for r in rows] == list(range(15)) and {r.visit for r in rows} == {0, 1, 2}
    plan = Q.update_plan(s, 25)
    assert {(r["update"], r.cursor) for r in Q.resume_points(plan, (0, 1)).collect()} == {(0, 0), (1, 3)}
    assert Q.schedule_violations(s, s).count() == 0
    assert {r.problem for r in Q.schedule_violations(s, s.where("cursor < 14")).collect()} == {"missing"}
    e = Q.exposure_plan(s).first()
    assert (e.appearances, e.exposure, e.least_repeats, e.most_repeats) == (15, 150, 2, 3)


def test_targets_and_loss(spark):
    x = sequences(spark).withColumn("eligible", Q.eligible_count(F.col("input_ids"), F.col("attention_mask")))
    x = x.join(Q.population_anchor(x, "0" * 64), "condition")
    s = Q.schedule(x, 1500, 1, 746, input_anchor="0" * 64, anchor="population_anchor")
    t = Q.selected_targets(s, x, {"p": 3})
    by = {r.example_identity: r for r in x.collect()}
    want = sum(len(masked(by[r.key].input_ids, by[r.key].attention_mask, r.key, 3, r.visit)[1]) for r in s.collect())
    assert t.agg(F.sum("targets")).first()[0] == want and Q.seed_audit(t).first()["pass"]
    loss = spark.createDataFrame([(1, 2.0, 4), (1, 4.0, 2)], "update int, numerator double, targets int")
    assert Q.normalized_loss(loss).first().loss == 1.0
    with pytest.raises(Exception, match="no targets"):
        Q.normalized_loss(loss.withColumn("targets", F.lit(0))).collect()
    assert Q.within_one_percent(spark.createDataFrame([(100,), (101,)], "v int"), "v").first()[0] and not Q.within_one_percent(spark.createDataFrame([(100,), (102,)], "v int"), "v").first()[0]
