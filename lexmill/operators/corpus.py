"""Corpus operators over utterance and training rows: context, projection, splits, selection, joins, summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import labels as L
from ..functions import text as X
from ..sources import readers as R

# --- context and projection -------------------------------------------------


def with_context(rows: DataFrame, conversation: str = "conversation_id", order: str = "ord") -> DataFrame:
    """Index and predecessor within the conversation, and the switch from it."""
    w = Window.partitionBy(conversation).orderBy(order)
    x = rows.withColumn("utterance_index", F.row_number().over(w) - 1)
    for new, old in (("previous_utterance_id", "utterance_id"), ("previous_speaker_id", "speaker_id"), ("previous_language_category", "language_category")):
        x = x.withColumn(new, F.lag(old).over(w))
    x = x.withColumn("same_speaker_as_previous", F.when(F.col("utterance_index") > 0, F.col("speaker_id").eqNullSafe(F.col("previous_speaker_id"))))
    is_switch, direction = L.switch(F.col("previous_language_category"), F.col("language_category"))
    return x.withColumn("is_inter_sentential_switch_from_previous", is_switch).withColumn("inter_sentential_switch_direction_from_previous", direction)


def annotated(utterances: DataFrame, neutral: bool = False) -> DataFrame:
    """P5, C1, C2, C9 and context of raw utterances (utterance_id, text, conversation_id, speaker_id, ord)."""
    x = utterances.withColumn("language_category", L.classify("text")).withColumn("condition_candidates", L.candidates(F.col("language_category"), neutral))
    x = x.withColumn("tokens", X.tokenize("text")).withColumn("token_language_labels", F.transform("tokens", L.token_label))
    x = x.withColumns(L.label_counts(F.col("token_language_labels")))
    return with_context(x).withColumn("clean_text", F.col("text"))


def toy_rows(spark: SparkSession, seed: int = 0, neutral: bool = False) -> DataFrame:
    """S18 in full: annotated toy utterances with stratified splits."""
    x = annotated(R.toy_utterances(spark), neutral)
    spoken = {r[0] for r in x.where(F.col("language_category").isin(*V.LANGUAGE_CATEGORIES)).select("conversation_id").distinct().collect()}
    rest = {r[2] for r in R.TOY} - spoken
    split = R.shuffled_splits(sorted(spoken), seed, need_all=True) | R.shuffled_splits(sorted(rest), seed)
    table = spark.createDataFrame(list(split.items()), "conversation_id string, split string")
    return x.join(F.broadcast(table), "conversation_id").withColumn("source", F.lit("toy_synthetic_v1"))


def project_words(utterances: DataFrame, split: str = "train", source: str = "bangor_cgwords", neutralize: bool = True, neutral: bool = False) -> DataFrame:
    """Grouped word utterances to utterance rows."""
    raw = F.zip_with("langids", "tokens", lambda tag, surface: L.langid_label(tag, surface))
    labels = L.neutralized(F.col("tokens"), raw) if neutralize else raw
    x = utterances.withColumn("source_token_language_labels", F.col("langids")).withColumn("token_language_labels", labels)
    x = x.withColumn("language_category", L.category_of_labels(F.col("token_language_labels"))).withColumn("needs_review_mixed_morpheme", F.array_contains("token_language_labels", "mixed_morpheme"))
    x = x.withColumn("condition_candidates", L.candidates(F.col("language_category"), neutral, F.col("needs_review_mixed_morpheme"))).withColumns(L.label_counts(F.col("token_language_labels")))
    return with_context(x).withColumns({"split": F.lit(split), "source": F.lit(source), "clean_text": F.col("text")})


def training_rows(chat: dict[str, DataFrame], source: str) -> DataFrame:
    """Cleaned rows with opaque references; text null marks a turn without lexical material, ``unresolved`` one to refuse."""
    conv = X.opaque_ref(F.col("file"), "conv")
    x = chat["utterances"].withColumn("conversation_ref", conv).withColumn("source", F.lit(source))
    x = x.withColumn("text", X.clean_surface("raw_main_tier_text")).withColumn("unresolved", X.has_unresolved_control("text"))
    x = x.withColumn("speaker_ref", X.opaque_ref(F.col("speaker_id"), "spk", F.col("conversation_ref")))
    return x.withColumn("row_id", X.opaque_ref(F.col("turn_index").cast("string"), "row", F.concat_ws("\0", "source", "conversation_ref")))


def project_turns(utterances: DataFrame, outcomes: DataFrame | None, language: str) -> DataFrame:
    """Turns with hashed references; turns without an outcome need review, roles only for clean ones."""
    x = utterances if outcomes is not None else utterances.withColumn("outcome", F.lit(None).cast("string"))
    if outcomes is not None:
        x = x.join(outcomes, ["file", "turn_index"], "left")
    x = x.withColumn("outcome", F.coalesce("outcome", F.lit("needs_review")))
    source = "callhome_" + language
    return x.select(F.lit(source).alias("source"), X.safe_ref(F.col("file"), "conv").alias("conversation_ref"), X.safe_ref(F.col("speaker_id"), "spk", F.col("file")).alias("speaker_ref"), "turn_index", "outcome", L.source_roles(F.lit(source), F.col("outcome") == "clean").alias("roles"))


# --- splits and selection ---------------------------------------------------


def hash_splits(rows: DataFrame, key: str = "conversation_ref", source: str = "source", seed: int = 1729, train: float = 0.90, validation: float = 0.05) -> DataFrame:
    """Whole keys of a source in order of SHA-256; the windows run over distinct keys only."""
    keys = rows.select(source, key).distinct()
    w = Window.partitionBy(source).orderBy(F.sha2(F.concat_ws("\0", F.lit(str(seed)), F.col(source), F.col(key).cast("string")), 256))
    n = F.count("*").over(Window.partitionBy(source))
    a, b = F.bround(n * F.lit(train)), F.bround(n * F.lit(validation))
    i = F.row_number().over(w) - 1
    keys = keys.withColumn("split", F.when(i < a, "train").when(i < a + b, "validation").otherwise("test"))
    return rows.drop("split").join(keys, [source, key])


def selection_key(row_id: Column, source: Column, split: Column, seed: int) -> Column:
    """O3."""
    return F.sha2(F.concat_ws("\0", F.lit(str(seed)), source, split, row_id.cast("string")), 256)


def greedy_quota(rows: DataFrame, target: int, group: list[str], size: str = "tokens", order: str = "key", row_id: str = "row_id", required: str | None = None) -> DataFrame:
    """Rows in order of (key, id), each taken if it still fits; ``required`` marks rows taken beforehand.

    First fit is sequential in a group; only ids, keys and sizes go there.
    """
    must = F.lit(False) if required is None else F.coalesce(F.col(required), F.lit(False))
    narrow = rows.select(*group, F.col(row_id).alias("__id"), F.col(order).alias("__key"), F.col(size).cast("long").alias("__n"), must.alias("__must"))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__key", "__id"], kind="stable")
        left = target - int(part["__n"][part["__must"]].sum())
        taken = []
        for n, first in zip(part["__n"], part["__must"], strict=True):
            ok = bool(first) or n <= left and left > 0
            left -= 0 if first or not ok else n
            taken.append(ok)
        return part.assign(taken=taken)[[*group, "__id", "taken"]]

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name in (*group, "__id"))
    picked = narrow.groupBy(*group).applyInPandas(fill, f"{kind}, taken boolean").where("taken").drop("taken").withColumnRenamed("__id", row_id)
    return rows.join(picked, [*group, row_id], "left_semi")


def nested_selection(rows: DataFrame, half: int, full: int, group: list[str]) -> DataFrame:
    """The half quota first, then the full one with those rows required; column ``in_half``."""
    part = greedy_quota(rows, half, group).select(*group, "row_id", F.lit(True).alias("in_half"))
    return greedy_quota(rows.join(part, [*group, "row_id"], "left"), full, group, required="in_half").withColumn("in_half", F.coalesce("in_half", F.lit(False)))


def quota_tolerance(target: int) -> int:
    return max(1, target // 1000)


# --- joins and checks -------------------------------------------------------


def reconcile(expected: DataFrame, frozen: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, problem) of a full outer comparison; empty if both sides agree."""
    a = expected.select(F.col(key).alias("__k"), *(F.col(f).alias("a_" + f) for f in fields))
    b = frozen.select(F.col(key).alias("__j"), *(F.col(f).alias("b_" + f) for f in fields))
    x = a.join(b, F.col("__k") == F.col("__j"), "full_outer")
    differs = F.lit(False)
    for f in fields:
        differs |= ~F.col("a_" + f).eqNullSafe(F.col("b_" + f))
    problem = F.when(F.col("__j").isNull(), "missing").when(F.col("__k").isNull(), "extra").when(differs, "differs")
    return x.select(F.coalesce("__k", "__j").alias(key), problem.alias("problem")).where("problem is not null")


def not_subset(part: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``part`` without a partner; empty for a subset."""
    return part.join(whole.select(*keys).distinct(), keys, "left_anti")


def conflicts(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with more than one value."""
    return rows.groupBy(*key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def priority_union(*parts: DataFrame, key: str) -> DataFrame:
    """Union where the earliest part wins a key; ties within a part go to the least row hash."""
    all_ = None
    for i, p in enumerate(parts):
        q = p.withColumn("__rank", F.lit(i))
        all_ = q if all_ is None else all_.unionByName(q)
    w = Window.partitionBy(key).orderBy("__rank", F.xxhash64(*[c for c in parts[0].columns]))
    return all_.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__rank")


def membership(tokens: DataFrame, lexicon: DataFrame, id_col: str, token_col: str = "token", broadcast_rows: int = 2_000_000) -> DataFrame:
    """Coverage of each id's tokens (duplicates count) by a lexicon (word). A lexicon is broadcast only if it is small."""
    words = lexicon.select(F.col("word").alias(token_col), F.lit(True).alias("__in")).distinct()
    side = F.broadcast(words) if words.count() <= broadcast_rows else words
    x = tokens.join(side, token_col, "left").groupBy(id_col).agg(F.count(token_col).alias("n_tokens"), F.count("__in").alias("n_covered"))
    return x.withColumn("n_uncovered", F.col("n_tokens") - F.col("n_covered")).withColumn("outcome", F.when(F.col("n_tokens") == 0, "no_lexical_tokens").when(F.col("n_uncovered") == 0, "all_covered").otherwise("has_uncovered"))


def releasable(aggregate: DataFrame, least: int = 10) -> DataFrame:
    """the one-row aggregate, or nothing if any of its counts is positive but below ``least``."""
    counts = F.array(*(F.col(c).cast("long") for c, t in aggregate.dtypes if t in ("bigint", "int")))
    return aggregate.where(F.forall(counts, lambda v: (v == 0) | (v >= least)))


def runs(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Maximal runs of consecutive values per key (gaps and islands)."""
    w = Window.partitionBy(*key).orderBy(order)
    x = rows.withColumn("__g", F.col(value) - F.row_number().over(w))
    return x.groupBy(*key, "__g").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("__g")


def ordered_checksum(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """SHA-256 over the values of a group in order, one a line."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("string"))
    return rows.groupBy(*group).agg(F.sha2(F.array_join(items, "\n"), 256).alias("sha256"))


# --- summaries --------------------------------------------------------------


def corpus_summary(rows: DataFrame, corpus_name: str = "corpus", seed: int = 0) -> DataFrame:
    """A1 to A4 and P10: one wide row; every key of a vocabulary is there, also with a zero."""
    cat, split = F.col("language_category"), F.col("split")
    is_cs = cat == "cs_within_utterance"
    to_spa, to_eng = L.transitions(F.col("token_language_labels"))
    sw, same = F.coalesce("is_inter_sentential_switch_from_previous", F.lit(False)), F.col("same_speaker_as_previous")
    way = F.col("inter_sentential_switch_direction_from_previous")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    aggs = {
        "n_utterances": F.count("*"), "n_conversations": F.count_distinct("conversation_id"),
        **{f"count__{c}": F.count_if(cat == c) for c in V.CATEGORIES},
        **{f"split__{s}": F.count_if(split == s) for s in V.SPLITS},
        **{f"split__{s}__{c}": F.count_if((split == s) & (cat == c)) for s in V.SPLITS for c in V.CATEGORIES},
        "total_tokens_including_punctuation": total("n_tokens_including_punctuation"), "n_word_tokens": total("n_word_tokens_excluding_punctuation"),
        "total_english_word_tokens": total("n_english_word_tokens"), "total_spanish_word_tokens": total("n_spanish_word_tokens"),
        "total_neutral_bivalent_word_tokens": total("n_neutral_bivalent_word_tokens"), "total_other_word_tokens": total("n_other_word_tokens"),
        "total_mixed_morpheme_word_tokens": total("n_mixed_morpheme_word_tokens"), "total_metadata_tokens": total("n_metadata_tokens"), "total_punctuation_tokens": total("n_punctuation_tokens"),
        "en_to_es_transitions": total(F.when(is_cs, to_spa)), "es_to_en_transitions": total(F.when(is_cs, to_eng)),
        "total_inter_sentential_switches": F.count_if(sw), "inter_sentential_switches_eng_to_spa": F.count_if(sw & (way == "eng_to_spa")), "inter_sentential_switches_spa_to_eng": F.count_if(sw & (way == "spa_to_eng")),
        "inter_sentential_switches_same_speaker": F.count_if(sw & same), "inter_sentential_switches_cross_speaker": F.count_if(sw & ~same),
        **{f"condition__{c}": F.count_if(F.array_contains("condition_candidates", c)) for c in V.CONDITIONS},
    }
    one = rows.agg(*(c.alias(n) for n, c in aggs.items()))
    spanning = rows.groupBy("conversation_id").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_conversation_ids_spanning_multiple_splits"))
    twice = lambda c, name: rows.groupBy(c).count().agg(F.count_if(F.col("count") > 1).alias(name))
    one = one.crossJoin(spanning).crossJoin(twice("utterance_id", "n_duplicate_utterance_ids")).crossJoin(twice("clean_text", "n_duplicate_utterance_texts"))
    spoken = sum((F.col(f"count__{c}") for c in V.LANGUAGE_CATEGORIES), F.lit(0))
    left_out = sum((F.col(f"count__{c}") for c in V.EXCLUDED_CATEGORIES), F.lit(0))
    return one.withColumns({
        "corpus_name": F.lit(corpus_name), "seed": F.lit(seed), "n_language_containing_utterances": spoken.cast("long"), "n_excluded_utterances": left_out.cast("long"),
        "total_switch_transitions": F.col("en_to_es_transitions") + F.col("es_to_en_transitions"),
        **{f"pct_all__{c}": X.percent(F.col(f"count__{c}"), F.col("n_utterances")) for c in V.CATEGORIES},
        **{f"pct_lang__{c}": X.percent(F.col(f"count__{c}"), spoken) for c in V.LANGUAGE_CATEGORIES},
    })


def ingestion_summary(words: DataFrame) -> DataFrame:
    """A5: counts by file and overall of tags and labels, as grouping sets."""
    x = words.withColumn("label", L.langid_label(F.col("langid"), F.col("surface")))
    x = x.select("filename", F.explode(F.array(F.struct(F.lit("langid").alias("kind"), F.col("langid").alias("value")), F.struct(F.lit("label").alias("kind"), F.col("label").alias("value")))).alias("e")).select("filename", "e.*")
    return x.groupingSets([["filename", "kind", "value"], ["kind", "value"]], "filename", "kind", "value").agg(F.count("*").alias("n"))


def outcome_counts(decisions: DataFrame, outcome: str, reasons: str | None, vocabulary) -> DataFrame:
    """Rows per outcome, zero-filled; overlapping reason counts beside."""
    spark = decisions.sparkSession
    base = spark.createDataFrame([("outcome", v) for v in vocabulary], "kind string, value string")
    n = decisions.groupBy(F.col(outcome).alias("value")).count().withColumn("kind", F.lit("outcome"))
    out = base.join(n, ["kind", "value"], "left")
    if reasons:
        r = decisions.select(F.explode(reasons).alias("value")).groupBy("value").count().withColumn("kind", F.lit("reason"))
        out = out.unionByName(r.select(out.columns))
    return out.select("kind", "value", F.coalesce("count", F.lit(0)).alias("n"))


def eligibility_summary(rows: DataFrame, conversation: str = "conversation_ref") -> DataFrame:
    """Measures per source and split, from rows with text, reason (null: eligible), source and split."""
    x = rows.withColumn("tokens", X.lexical_count("text").cast("long")).withColumn("ok", F.col("reason").isNull())
    per = x.groupBy("source", "split", conversation).agg(
        F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.count_if("ok").alias("ok_rows"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("tokens"))), F.lit(0)).alias("ok_tokens"),
        *(F.count_if(F.col("reason") == r).alias(f"excluded__{r}") for r in V.EXCLUSION_REASONS),
    )
    y = per.groupBy("source", "split").agg(
        F.sum("rows").alias("source_rows"), F.sum("tokens").alias("approximate_lexical_tokens"), F.sum("ok_rows").alias("eligible_rows"), F.sum("ok_tokens").alias("eligible_tokens"),
        *(F.sum(f"excluded__{r}").alias(f"excluded__{r}") for r in V.EXCLUSION_REASONS),
        F.count_if(F.col("ok_rows") < F.col("rows")).alias("affected_conversations"), F.count_if(F.col("ok_rows") == 0).alias("conversations_with_zero_eligible_rows"), F.max("ok_tokens").alias("__most"),
    )
    return y.withColumns({
        "rows_removed_percent": X.percent(F.col("source_rows") - F.col("eligible_rows"), F.col("source_rows"), 6),
        "tokens_removed_percent": X.percent(F.col("approximate_lexical_tokens") - F.col("eligible_tokens"), F.col("approximate_lexical_tokens"), 6),
        "maximum_conversation_eligible_token_percent": X.percent(F.col("__most"), F.col("eligible_tokens"), 6),
    }).drop("__most")
