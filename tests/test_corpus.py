import pytest
from pyspark.sql import functions as F

from lexmill import schema, vocab
from lexmill.functions import labels as L
from lexmill.functions import text as X
from lexmill.operators import corpus as C
from lexmill.operators import sinks
from lexmill.plans import sequences as Q
from lexmill.sources import readers as R


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


def test_toy_summary(spark):
    s = C.corpus_summary(C.toy_rows(spark)).first()
    assert (s["n_utterances"], s["n_conversations"], s["n_word_tokens"], s["total_tokens_including_punctuation"], s["total_punctuation_tokens"]) == (18, 6, 77, 102, 25)
    assert (s["total_english_word_tokens"], s["total_spanish_word_tokens"], s["total_neutral_bivalent_word_tokens"], s["total_other_word_tokens"]) == (39, 28, 4, 6)
    assert [s[f"count__{c}"] for c in vocab.CATEGORIES] == [4, 4, 3, 2, 2, 1, 2]
    assert [s[f"split__{x}"] for x in vocab.SPLITS] == [11, 2, 5]
    assert [s[f"split__test__{c}"] for c in vocab.CATEGORIES] == [1, 1, 0, 0, 0, 1, 2]
    assert (s["en_to_es_transitions"], s["es_to_en_transitions"]) == (5, 5)
    assert (s["total_inter_sentential_switches"], s["inter_sentential_switches_eng_to_spa"], s["inter_sentential_switches_same_speaker"]) == (3, 2, 2)
    assert (s["pct_all__en_only"], s["pct_lang__cs_within_utterance"], s["pct_all__mixed_or_uncertain"]) == (22.2222, 27.2727, 5.5556)
    assert {c: s[f"condition__{c}"] for c in vocab.CONDITIONS} == {"CsCont": 11, "EnglishMono": 4, "MonoCont": 8, "SpanishMono": 4}
    assert schema.violations(C.toy_rows(spark).withColumn("source_token_language_labels", F.lit(None).cast("array<string>"))).count() == 0


@pytest.mark.parametrize(("langid", "surface", "label"), [("eng", "hi", "eng"), ("eng&spa", "www", "metadata"), ("999", "¿", "punct"), ("999", "ñ", "other"), ("eng+spa", "x", "mixed_morpheme"), ("", "x", "other"), ("www", "x", "metadata")])
def test_langid_labels(spark, langid, surface, label):
    assert one(spark, L.langid_label(F.col("a"), F.col("b")), a=langid, b=surface) == label


@pytest.mark.parametrize(("text", "clean"), [("hola [/] <que tal> .", "hola que tal ."), ("&-um yes &=laughs (..) xxx +...", "um yes"), ("xxx .", None), ("[- spa] no [= x] mas\x15123\x15", "no mas"), ("&+fr friend +, ok", "friend ok")])
def test_clean_surface(spark, text, clean):
    assert one(spark, X.clean_surface(F.col("a")), a=text) == clean


def test_normalize_and_lexical_tokens(spark):
    assert one(spark, X.lexical_tokens("a"), a="¿Don't! xxx &uh [x] (..) 12 co-op.") == ["don't", "co-op"]


def test_word_file(spark, tmp_path):
    rows = ["\t".join(vocab.WORD_COLUMNS), "2\t1\t2\tamigo\t\t\t\t\tA\tspa\therring1", "1\t1\t1\tmy\t\t\t\t\tA\teng\therring1", "", "3\t2\t1\tum\t\t\t\t\tB\teng\t", "(3 rows)"]
    path = tmp_path / "herring1_cgwords.tsv"
    path.write_text("\n".join(rows) + "\n", encoding="utf-8")
    x = R.group_words(R.read_words(spark, str(path)))
    p = {r["utterance_id"]: r for r in C.project_words(x).collect()}
    assert p["herring1_000001"]["tokens"] == ["my", "amigo"] and p["herring1_000001"]["language_category"] == "cs_within_utterance"
    assert p["herring1_000002"]["token_language_labels"] == ["neutral"] and p["herring1_000002"]["previous_utterance_id"] == "herring1_000001"
    assert tuple(R.word_file_counters(spark, str(path)).first())[1:] == (1, 1)


def test_chat_file(spark, tmp_path):
    path = tmp_path / "a.cha"
    path.write_text("@UTF8\n@Languages:\teng, spa\n*A:\thello there .\n%mor:\tx\n%snd:\tm1\n*B:\thola .\n", encoding="utf-8")
    c = R.read_chat(spark, str(path))
    u = {r["turn_index"]: r for r in c["utterances"].collect()}
    assert (u[0]["speaker_id"], u[0]["raw_main_tier_text"], u[0]["language"], u[0]["media_id"]) == ("A", "hello there .", "eng", "m1")
    assert [t["prefix"] for t in u[0]["dependent_tiers"]] == ["%mor", "%snd"] and u[1]["dependent_tiers"] is None
    assert R.chat_violations(spark, str(path)).count() == 0
    bad = tmp_path / "b.cha"
    bad.write_bytes(b"@Begin\n*A:\tx\n")
    assert R.chat_violations(spark, str(bad)).first()["violation"] == "missing UTF8 header"
    rows = C.training_rows(c, "callhome_eng").orderBy("turn_index").collect()
    assert rows[0]["text"] == "hello there ." and rows[0]["row_id"].startswith("row_") and len(rows[0]["row_id"]) == 20


def test_word_lists(spark, tmp_path):
    path = tmp_path / "x.dic"
    path.write_text("3\nhola/S\nadios\n# no\n", encoding="utf-8")
    assert sorted(r[0] for r in R.read_word_list(spark, str(path), dictionary=True).collect()) == ["adios", "hola"]


def test_greedy_and_nested(spark):
    x = spark.createDataFrame([("g", i, n, str(i)) for i, n in enumerate((5, 7, 3, 2, 1))], "g string, row_id int, tokens int, key string")
    assert sorted(r["row_id"] for r in C.greedy_quota(x, 9, ["g"]).collect()) == [0, 2, 4]
    y = C.nested_selection(x, 5, 9, ["g"]).collect()
    assert {r["row_id"] for r in y if r["in_half"]} == {0} and sum(r["tokens"] for r in y) <= 9


def test_reconcile_and_guard(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "k int, v string")
    assert {(r["k"], r["problem"]) for r in C.reconcile(a, b, "k", ["v"]).collect()} == {(2, "differs"), (3, "extra")}
    assert C.releasable(spark.sql("select 10L a, 0L b")).count() == 1 and C.releasable(spark.sql("select 9L a")).count() == 0


def test_publish(spark, tmp_path):
    x = spark.createDataFrame([("b", None), ("a", "é")], "id string, v string")
    sinks.publish({"rows.jsonl": (x, ["id"])}, str(tmp_path / "out"), {"n": 2})
    assert (tmp_path / "out" / "rows.jsonl").read_text(encoding="utf-8") == '{"id":"a","v":"é"}\n{"id":"b","v":null}\n'
    assert sinks.verify(str(tmp_path / "out")) == []
    with pytest.raises(FileExistsError):
        sinks.publish({}, str(tmp_path / "out"), {})


def test_entry_without_llm():
    import __spark_entry__ as e

    assert {"c12_w1_switch_context", "o4_greedy_quota"} <= e.queries().keys() and e.oracle_sql().keys() <= e.queries().keys()
