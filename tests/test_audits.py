"""Folder scans, strict files, protocol, model-input rows and streams on small fixtures."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import audits as A
from lexmill.operators import corpus as C
from lexmill.sources import readers as R
from lexmill.streaming import folds

CHAT = "@UTF8\n@Languages:\teng, spa\n@Media:\tm, audio\n*A:\thello there\n\tmy friend .\n%snd:\tx_1\n*B:\tyes .\n@End\n"


def test_folder_and_strict_chat(spark, tmp_path):
    (tmp_path / "b.cha").write_text(CHAT, encoding="utf-8")
    (tmp_path / "a.cha").write_text("@Begin\n*A:\tx\n", encoding="utf-8")
    (tmp_path / "c.txt").write_text("x", encoding="utf-8")
    names = A.list_files(spark, str(tmp_path), expected=2)
    assert [n.rsplit("/", 1)[-1] for n in names] == ["a.cha", "b.cha"]
    with pytest.raises(ValueError):
        A.list_files(spark, str(tmp_path), expected=3)
    got = A.tolerant_scan(spark, names)
    assert [(r.file, r.violation) for r in got["failed"].collect()] == [("a.cha", "missing UTF8 header")] and got["utterances"].count() == 2
    with pytest.raises(ValueError, match="missing UTF8 header"):
        A.read_strict_chat(spark, names)
    strict = A.read_strict_chat(spark, [names[1]])
    assert [r.raw_main_tier_text for r in strict["utterances"].orderBy("turn_index").collect()] == ["hello there my friend .", "yes ."]
    assert strict["warnings"].count() == 0
    s = {(r.measure, r.key): r.n for r in A.transcript_summary(strict, 2).collect()}
    assert s[("header", "@Languages")] == s[("n_files_with_media_header", "")] == 1 and s[("tier", "%snd")] == 1 and s[("n_files", "")] == s[("n_utterances", "")] == 2


def test_strict_jsonl_and_lists(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a":1}\n{"a":2}\n', encoding="utf-8")
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n[2]\n{"a"\n{"a":3}', encoding="utf-8")
    assert A.strict_jsonl_violations(spark, str(tmp_path / "good.jsonl")).count() == 0
    assert {(r.line, r.problem) for r in A.strict_jsonl_violations(spark, str(tmp_path / "bad.jsonl")).collect()} == {(1, "no JSON object"), (2, "no JSON object"), (None, "no final newline")}
    (tmp_path / "w.txt").write_text("abc\nabd\nb\n", encoding="utf-8")
    (tmp_path / "v.txt").write_text("b\na c\nb", encoding="utf-8")
    digest = hashlib.sha256(b"abc\nabd\nb\n").hexdigest()
    assert A.word_list_violations(spark, str(tmp_path / "w.txt"), digest).count() == 0
    assert {r.problem for r in A.word_list_violations(spark, str(tmp_path / "v.txt"), digest).collect()} == {"no final newline", "blank or spaced entry", "not strictly ascending", "other digest"}
    (tmp_path / "u.jsonl").write_text('{"split":"train","text":"x"}\n{"split":"test","text":"y"}\n', encoding="utf-8")
    assert [r.text for r in R.read_unsealed(spark, str(tmp_path / "u.jsonl"), "split string, text string").collect()] == ["x"]


def test_checker_protocol(spark):
    x = spark.createDataFrame([(["a", "b", "c"], "H\n*\n\n# b 0\n\n& c 1 0: d\n\n")], "t array<string>, r string")
    row = x.select(A.checker_input(F.col("t")), A.checker_verdicts(F.col("r"), F.col("t"), "H\n")).first()
    assert row[0] == "^a\n^b\n^c\n" and row[1] == [True, False, False]
    for bad in ("*\n\n", "H\n*\n\n", "H\n*\n\n*\n\n*\n", "H\n*\n\n# x 0\n\n*\n\n"):
        with pytest.raises(Exception, match="unexpected checker response"):
            spark.createDataFrame([(["a", "b", "c"], bad)], "t array<string>, r string").select(A.checker_verdicts(F.col("r"), F.col("t"), "H\n")).collect()


def test_nfc(spark):
    x = spark.createDataFrame([("Cafe\u0301 sí",), ("plain",), (None,)], "text string")
    assert [r[0] for r in x.select(X.clean_surface("text")).collect()] == ["Café sí", "plain", None]
    assert [r[0] for r in x.select(X.lexical_tokens("text")).collect()] == [["café", "sí"], ["plain"], []]
    assert A.normalize_lexicon(spark.createDataFrame([("Cafe\u0301",), ("café.",), ("--",)], "word string")).collect()[0].word == "café"


def test_model_rows(spark):
    rows = spark.createDataFrame([("callhome_eng", "train", "a b", 2), ("callhome_eng", "train", "!", 0)], "source string, split string, text string, lexical_tokens int")
    assert [r.lexical_tokens for r in A.checked_rows(rows, {"callhome_eng": "eng"}).collect()] == [2, 0]
    for change, why in (({"source": "x"}, "unknown source"), ({"split": "dev"}, "unknown split"), ({"lexical_tokens": 5}, "another lexical count"), ({"text": "12", "lexical_tokens": 0}, "no lexical token")):
        with pytest.raises(Exception, match=why):
            A.checked_rows(rows.withColumns({k: F.lit(v) for k, v in change.items()}), {"callhome_eng": "eng"}).collect()
    assert "text" not in A.without_text(rows).columns
    x = spark.createDataFrame([("MonoCont", "train", "s", "c1", None, "r1", 0, [5]), ("CsCont", "train", "s", "c1", "p1", "r2", 1, [6])], "condition string, split string, source string, conversation_ref string, span_id string, row_id string, turn_index int, token_ids array<int>")
    a, b = A.packing_inputs(x, "token_ids", b"key").orderBy("row_order").collect()
    assert a.document_id == a.conversation_id == b.conversation_id != b.document_id == b.span_id and a.language_shard == "s" and b.language_shard is None and len(a.row_id) == 64
    packed = spark.createDataFrame([("c", "train", "s", [("r", 0, 3), ("q", 0, 1)]), ("c", "train", "s", [("r", 3, 5)])], "condition string, split string, source string, provenance array<struct<row_id:string,source_start:int,source_end:int>>")
    source = spark.createDataFrame([("c", "train", "s", "r", [1] * 5), ("c", "train", "s", "q", [1] * 2), ("c", "train", "s", "z", [1])], "condition string, split string, source string, row_id string, token_ids array<int>")
    assert {(r.row_id, r.problem) for r in A.fragment_breaks(packed, source).collect()} == {("q", "broken"), ("z", "missing")}
    assert A.training_only(packed, {"c": 2}).count() == 2
    with pytest.raises(Exception, match="unexpected number"):
        A.training_only(packed, {"c": 3}).collect()
    order = spark.createDataFrame([("b", "x", 1), ("a", "y", 2), ("a", "x", 3)], "component string, role string, ordinal int")
    assert [r.ordinal for r in A.preparation_order(order, {"a": 0, "b": 1}).collect()] == [3, 2, 1]


def test_sample_summary(spark):
    rows = C.annotated(spark.createDataFrame([("u", "um hello", "c", "s", 0), ("v", "hola", "c", "s", 1)], "utterance_id string, text string, conversation_id string, speaker_id string, ord int"))
    rows = rows.withColumn("source_token_language_labels", F.transform("token_language_labels", lambda x: F.lit("eng"))).withColumn("token_language_labels", F.transform("tokens", lambda t: F.when(t == "um", "neutral").otherwise("eng")))
    s = A.sample_summary(rows).first()
    assert s.n_utterances == 2 and s.n_neutralized_disfluency_tokens == 1 and s.check__labels_aligned and s.check__labels_known and s.check__categories_known
    empty = A.sample_summary(rows.limit(0)).first()
    assert empty.n_utterances == 0 and empty.check__labels_known
    with pytest.raises(Exception, match="empty population"):
        A.coverage_summary(spark.createDataFrame([], "outcome string, n_tokens long, n_covered long")).collect()


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7), ("a", 4, 1)], "k string, i long, v long").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {tuple(r) for r in spark.table(name).collect()}

    measures = {"n": F.count("*"), "total": F.sum("v")}
    assert run(folds.counters(stream, ["k"], measures), "counted", "complete") == {("a", 3, 12), ("b", 1, 7)} == {tuple(r) for r in folds.counters(rows, ["k"], measures).collect()}
    assert run(folds.order_breaks(stream, "k", "i"), "breaks", "append") == {("a", 2, 4)}
