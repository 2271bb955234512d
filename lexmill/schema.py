"""The utterance row and its invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab as V
from .functions import labels as L

_S, _I, _B, _A = T.StringType(), T.IntegerType(), T.BooleanType(), T.ArrayType(T.StringType())
COUNTS = (
    "n_tokens_including_punctuation", "n_word_tokens_excluding_punctuation", "n_english_word_tokens", "n_spanish_word_tokens", "n_neutral_bivalent_word_tokens",
    "n_other_word_tokens", "n_punctuation_tokens", "n_mixed_morpheme_word_tokens", "n_metadata_tokens",
)

#: Field order is the order of serialized rows.
UTTERANCE = T.StructType([T.StructField(n, t) for n, t in (
    ("utterance_id", _S), ("text", _S), ("source", _S), ("conversation_id", _S), ("speaker_id", _S), ("split", _S), ("language_category", _S),
    ("condition_candidates", _A), ("raw_text", _S), ("clean_text", _S), ("tokens", _A), ("token_language_labels", _A), ("source_token_language_labels", _A),
    *((c, _I) for c in COUNTS),
    ("utterance_index", _I), ("previous_utterance_id", _S), ("previous_speaker_id", _S), ("previous_language_category", _S), ("same_speaker_as_previous", _B),
    ("is_inter_sentential_switch_from_previous", _B), ("inter_sentential_switch_direction_from_previous", _S),
    ("matrix_language_heuristic", _S), ("borrowing_heuristic", _S), ("equivalence_heuristic", _S),
    ("needs_review_borrowing", _B), ("needs_review_matrix_language", _B), ("needs_review_equivalence", _B), ("needs_review_mixed_morpheme", _B),
)])


def violations(rows: DataFrame) -> DataFrame:
    """(utterance_id, rule) for every invariant that a row breaks; empty for valid rows."""
    filled = F.size("tokens") > 0
    stored = F.lit(False)
    for name, want in L.label_counts(F.col("token_language_labels")).items():
        stored |= filled & (F.col(name) != want)
    known = lambda c, values: F.col(c).isNotNull() & ~F.col(c).isin(*values)
    switch = F.coalesce("is_inter_sentential_switch_from_previous", F.lit(False))
    rules = {
        "category": known("language_category", V.CATEGORIES),
        "split": known("split", V.SPLITS),
        "conditions": F.size(F.array_except("condition_candidates", F.array(*map(F.lit, V.CONDITIONS)))) > 0,
        "labels": F.size(F.array_except("token_language_labels", F.array(*map(F.lit, V.TOKEN_LABELS)))) > 0,
        "parallel": (F.size("tokens") != F.size("token_language_labels")) | (F.col("source_token_language_labels").isNotNull() & (F.size("source_token_language_labels") != F.size("tokens"))),
        "counts": stored,
        "switch": switch & (F.col("previous_utterance_id").isNull() | F.col("previous_language_category").isNull() | F.col("same_speaker_as_previous").isNull() | ~F.coalesce(F.col("inter_sentential_switch_direction_from_previous").isin("eng_to_spa", "spa_to_eng"), F.lit(False))),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return rows.select("utterance_id", F.explode(broken).alias("rule"))


def strict(rows: DataFrame) -> DataFrame:
    """``rows``, after an action that fails on the first violation."""
    bad = violations(rows).first()
    if bad:
        raise ValueError(f"{bad['utterance_id']}: {bad['rule']}")
    return rows
