"""Queries of the library's own operators over the driver's tables, with SQL that computes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vocab as V
from .functions import labels as L
from .functions import text as X
from .operators import audits as A
from .operators import corpus as C
from .plans import sequences as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _talk(spark, d) -> DataFrame:
    x = _t(spark, d, "conversations")
    return x.select(F.concat_ws("-", "conv_id", "turn").alias("utterance_id"), "text", F.col("conv_id").cast("string").alias("conversation_id"), F.col("role").alias("speaker_id"), F.col("turn").alias("ord"))


def _in(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


_L = "a-záéíóúñü"
_TOK = f"regexp_extract_all(coalesce(text, ''), '(?i)([{_L}]+|[^\\s{_L}])')"
_LABEL = f"""CASE WHEN regexp_matches(k, '(?i)^[{_L}]+$') THEN CASE WHEN lower(k) IN {_in(V.BIVALENT_WORDS)} THEN 'eng&spa' WHEN lower(k) IN {_in(V.ENGLISH_WORDS)} THEN 'eng'
  WHEN lower(k) IN {_in(V.SPANISH_WORDS)} THEN 'spa' WHEN lower(k) IN {_in(V.NEUTRAL_WORDS)} THEN 'neutral' ELSE 'other' END
  WHEN regexp_matches(k, '^[.,!?¿¡\\-–—''"…:;()\\[\\]{{}}<>%&/\\\\]+$') THEN 'punct' ELSE 'other' END"""
_WORDS = f"list_transform(regexp_extract_all(coalesce(text, ''), '(?i)[{_L}]+'), lambda w: lower(w))"


def _category(text: str = "text") -> str:
    return f"""CASE WHEN regexp_matches({text}, '^\\s*[\\[<][^\\n]*[\\]>]\\s*$|^\\s*[A-Z][A-Z0-9_]*\\s*:\\s*$|^\\s*%\\w+:') THEN 'metadata_or_noise'
  WHEN regexp_matches({text}, '^[\\s.,!?¿¡\\-–—''"…]*$') OR len(w) = 0 THEN 'punctuation_or_empty'
  WHEN list_has_any(w, [{_in(V.ENGLISH_WORDS)[1:-1]}]) AND list_has_any(w, [{_in(V.SPANISH_WORDS)[1:-1]}]) THEN 'cs_within_utterance'
  WHEN list_has_any(w, [{_in(V.ENGLISH_WORDS)[1:-1]}]) THEN 'en_only' WHEN list_has_any(w, [{_in(V.SPANISH_WORDS)[1:-1]}]) THEN 'es_only'
  WHEN list_has_any(w, [{_in(V.NEUTRAL_WORDS)[1:-1]}]) AND len(list_filter(w, lambda v: v NOT IN {_in(V.ENGLISH_WORDS + V.SPANISH_WORDS + V.NEUTRAL_WORDS)})) = 0 THEN 'neutral_or_bivalent'
  ELSE 'mixed_or_uncertain' END"""


_CAT_CTE = f"""c AS (SELECT conv_id, turn, role, text, {_category("text")} AS cat FROM (SELECT *, {_WORDS} AS w FROM conversations))"""


@query(f"""
WITH {_CAT_CTE}, p AS (SELECT *, lag(cat) OVER (PARTITION BY conv_id ORDER BY turn) AS pcat, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prole,
  lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS pturn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM c)
SELECT conv_id, turn, cat AS category, i AS utterance_index, pturn AS previous_turn, prole AS previous_role, CASE WHEN i > 0 THEN role = prole END AS same_speaker,
  CASE WHEN pcat IN ('en_only', 'es_only') AND cat IN ('en_only', 'es_only') THEN pcat <> cat END AS is_switch FROM p""")
def c12_w1_switch_context(spark, d):
    x = C.with_context(_talk(spark, d).withColumn("language_category", L.classify("text")))
    return x.select(
        F.col("conversation_id").cast("long").alias("conv_id"), F.col("ord").alias("turn"), F.col("language_category").alias("category"), F.col("utterance_index").cast("long").alias("utterance_index"),
        F.split("previous_utterance_id", "-")[1].cast("long").alias("previous_turn"), F.col("previous_speaker_id").alias("previous_role"), F.col("same_speaker_as_previous").alias("same_speaker"), F.col("is_inter_sentential_switch_from_previous").alias("is_switch"),
    )


@query(f"""
WITH k AS (SELECT doc_id, unnest({_TOK}) AS k FROM documents), l AS (SELECT doc_id, {_LABEL} AS label FROM k)
SELECT d.doc_id, count(label) AS n_tokens, count(label) FILTER (label <> 'punct') AS n_words, count(*) FILTER (label = 'eng') AS n_eng, count(*) FILTER (label = 'spa') AS n_spa,
  count(*) FILTER (label IN ('neutral', 'eng&spa')) AS n_neutral, count(*) FILTER (label = 'other') AS n_other, count(*) FILTER (label = 'punct') AS n_punct
FROM documents d LEFT JOIN l USING (doc_id) GROUP BY 1""")
def c2_x1_token_labels(spark, d):
    n = L.label_counts(F.col("labels"))
    names = {"n_tokens": "n_tokens_including_punctuation", "n_words": "n_word_tokens_excluding_punctuation", "n_eng": "n_english_word_tokens", "n_spa": "n_spanish_word_tokens", "n_neutral": "n_neutral_bivalent_word_tokens", "n_other": "n_other_word_tokens", "n_punct": "n_punctuation_tokens"}
    x = _t(spark, d, "documents").select("doc_id", F.transform(X.tokenize("text"), L.token_label).alias("labels"))
    return x.select("doc_id", *(n[v].cast("long").alias(k) for k, v in names.items()))


@query(f"""
SELECT lang, {_category("text")} AS category, count(*) AS n FROM (SELECT *, {_WORDS} AS w FROM documents) GROUP BY 1, 2""")
def c1_category_counts(spark, d):
    return _t(spark, d, "documents").groupBy("lang", L.classify("text").alias("category")).agg(F.count("*").alias("n"))


@query(r"""
SELECT lang, source, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x1c-\x1f]+'), lambda t: regexp_matches(t, '\p{L}'))))::BIGINT AS lexical, count(*) AS docs FROM documents GROUP BY 1, 2""")
def x6_lexical_counts(spark, d):
    return _t(spark, d, "documents").groupBy("lang", "source").agg(F.sum(X.lexical_count("text").cast("long")).alias("lexical"), F.count("*").alias("docs"))


@query("""
SELECT conv_id, turn, printf('%s_%06d', 'conv' || conv_id, turn) AS uid, 'conv_' || substr(sha1(chr(0) || conv_id), 1, 12) AS safe, 'row_' || substr(sha256('row' || chr(0) || role || chr(0) || turn), 1, 16) AS opaque FROM conversations""")
def x8_x10_x11_references(spark, d):
    x = _t(spark, d, "conversations")
    return x.select("conv_id", "turn", X.global_utterance_id(F.concat(F.lit("conv"), "conv_id"), F.col("turn")).alias("uid"), X.safe_ref(F.col("conv_id").cast("string"), "conv").alias("safe"), X.opaque_ref(F.col("turn").cast("string"), "row", F.col("role")).alias("opaque"))


@query(r"""
SELECT source, count(*) AS n, count(*) FILTER (len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '' AND lower(t) NOT IN ('xxx', 'yyy', 'www', '0') AND t NOT IN ('+/.', '+//.', '+...', '+..?', '++', '+^', '+<', '+/?')
  AND NOT starts_with(t, '&') AND NOT (starts_with(t, '[') AND ends_with(t, ']')) AND NOT (starts_with(t, '(') AND ends_with(t, ')')) AND regexp_matches(t, '\p{L}'))) > 0) AS lexical,
  count(*) FILTER (regexp_matches(coalesce(text, ''), '[\p{Cc}\p{Cf}]') OR len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: regexp_matches(t, '[\[\]<>]|^[&+]'))) > 0) AS unresolved FROM documents GROUP BY 1""")
def f1_f3_text_filters(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(X.has_lexical_content("text")).alias("lexical"), F.count_if(X.has_unresolved_control("text")).alias("unresolved"))


@query("""
WITH s AS (SELECT d.doc_id, CASE WHEN d.lang IN ('en', 'es') THEN true ELSE false END AS supported, coalesce(d.text, '') = '' AS empty, coalesce(l.toxic, 0) = 1 AS foreign_, coalesce(l.quality, 1) = 0 AS warning, l.quality IS NOT NULL AS seen FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT outcome, count(*) AS n, count(*) FILTER (has_warning) AS warnings FROM (SELECT CASE WHEN NOT supported OR empty THEN 'excluded' WHEN foreign_ OR warning THEN 'needs_review' WHEN seen THEN 'clean' ELSE 'needs_review' END AS outcome,
  supported AND warning AS has_warning FROM s) GROUP BY 1""")
def c5_c7_screening(spark, d):
    x = _t(spark, d, "documents").join(_t(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    lang = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "es", "spa").otherwise(F.col("lang"))
    seen = F.col("quality").isNotNull()
    dec = L.screen(lang, F.coalesce("text", F.lit("")) == "", F.coalesce("toxic", F.lit(0)) == 1, F.coalesce("quality", F.lit(1)) == 0, F.lit(False))
    x = x.select(dec.alias("dec"), seen.alias("ok"))
    return x.groupBy(L.combine(F.col("dec"), F.col("ok")).alias("outcome")).agg(F.count("*").alias("n"), F.count_if(F.array_contains("dec.reasons", "parser_warning")).alias("warnings"))


_PRECODES = ("hola", "[- spa] hola", "[- eng] hi", "[- eng, spa] hi", "[- ?] x", "[- und] x", "[- mul] x", "[- spa] a [- eng] b", "[-spa] x", "[- xx] x", "[- spa, spa] x", "[ - spa] x")
_REASONS = (None, None, V.EXCLUSION_REASONS[0], V.EXCLUSION_REASONS[1], V.EXCLUSION_REASONS[2], V.EXCLUSION_REASONS[2], V.EXCLUSION_REASONS[1], V.EXCLUSION_REASONS[3], "error", "error", "error", "error")


@query("SELECT r AS reason, count(*) AS n FROM (SELECT [" + ", ".join("NULL" if r is None else f"'{r}'" for r in _REASONS) + "][doc_id % 12 + 1] AS r FROM documents) GROUP BY 1")
def c6_precodes(spark, d):
    text = F.element_at(F.array(*map(F.lit, _PRECODES)), (F.col("doc_id") % 12 + 1).cast("int"))
    x = _t(spark, d, "documents").select(L.precode_eligibility(text, F.lit("spa")).alias("e"))
    return x.groupBy(F.when(F.col("e.error"), "error").otherwise(F.col("e.reason")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
WITH k AS (SELECT doc_id, unnest(t) AS k, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {_TOK} AS t FROM documents)), l AS (SELECT doc_id, i, {_LABEL} AS label FROM k),
p AS (SELECT doc_id, label AS b, lag(label) OVER (PARTITION BY doc_id ORDER BY i) AS a FROM l WHERE label IN ('eng', 'spa'))
SELECT d.doc_id, count(*) FILTER (a = 'eng' AND b = 'spa') AS eng_to_spa, count(*) FILTER (a = 'spa' AND b = 'eng') AS spa_to_eng FROM documents d LEFT JOIN p USING (doc_id) GROUP BY 1""")
def w3_transitions(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.transform(X.tokenize("text"), L.token_label).alias("labels"))
    a, b = L.transitions(F.col("labels"))
    return x.select("doc_id", a.cast("long").alias("eng_to_spa"), b.cast("long").alias("spa_to_eng"))


@query("""
WITH k AS (SELECT DISTINCT lang AS source, source AS conv FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('1729' || chr(0) || source || chr(0) || conv)) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM k)
SELECT source, conv, CASE WHEN i < round_even(n * 0.9, 0) THEN 'train' WHEN i < round_even(n * 0.9, 0) + round_even(n * 0.05, 0) THEN 'validation' ELSE 'test' END AS split FROM o""")
def w4_hash_splits(spark, d):
    x = _t(spark, d, "documents").select(F.col("lang").alias("source"), F.col("source").alias("conv")).distinct()
    return C.hash_splits(x, "conv").select("source", "conv", "split")


_ANCHOR = "0" * 64
_SCHEDULED = f"""
WITH i AS (SELECT lang, doc_id, n_chars % 126 + 1 AS w, p FROM documents, (SELECT unnest([0, 1, 2]) AS p)),
g AS (SELECT *, sha256('["{Q.SCHEDULE_PROTOCOL}","complete_population_permutation",["input_population_anchor","{_ANCHOR}"],["condition_population_anchor",""],["condition","' || lang || '"],["zero_based_pass_index",' || p || '],["packed_sequence_identity","' || doc_id || '"]]' || chr(10)) AS h FROM i),
o AS (SELECT *, row_number() OVER own - 1 AS cur, coalesce(sum(w) OVER (own ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM g WINDOW own AS (PARTITION BY lang ORDER BY p, h, doc_id)),
s AS (SELECT lang, doc_id, p, w, cur, b, b // 746 + 1 AS u FROM o WHERE p < 2 OR b < 100000)"""


def _scheduled(spark, d) -> DataFrame:
    x = _t(spark, d, "documents").select("lang", F.col("doc_id").cast("string").alias("key"), F.col("doc_id").alias("at"), (F.col("n_chars") % 126 + 1).alias("w"))
    return Q.schedule(x, 100_000, 2, 746, group="lang", key="key", weight="w", index="at", input_anchor=_ANCHOR)


@query(_SCHEDULED + "SELECT lang, doc_id::VARCHAR AS key, p AS pass_index, p AS visit, w, cur AS cursor, b AS before, u AS update, (cur - min(cur) OVER (PARTITION BY lang, u)) // 16 AS microbatch FROM s")
def w6_w9_schedule(spark, d):
    x = _scheduled(spark, d)
    return x.select("lang", "key", *(F.col(c).cast("long").alias(c) for c in ("pass_index", "visit", "w", "cursor", "before", "update", "microbatch")))


@query(_SCHEDULED + """, r AS (SELECT lang, u, min(cur) AS a, max(cur) + 1 AS z, sum(w)::BIGINT AS e, max(b + w)::BIGINT AS c, ((max(cur) - min(cur)) // 16) + 1 AS m FROM s GROUP BY 1, 2)
SELECT lang, u AS update, a AS start, z AS "end", e AS exposure, m AS microbatches, c AS cumulative, c - u * 746 AS token_credit FROM r""")
def w8_update_plan(spark, d):
    x = Q.update_plan(_scheduled(spark, d), 746, group="lang")
    return x.select("lang", *(F.col(c).cast("long").alias(c) for c in ("update", "start", "end", "exposure", "microbatches", "cumulative", "token_credit")))


@query(_SCHEDULED + """, k AS (SELECT lang, doc_id, count(*) AS n FROM s GROUP BY 1, 2), r AS (SELECT lang, count(*) AS sequences, min(n) AS lo, max(n) AS hi FROM k GROUP BY 1),
q AS (SELECT lang, u, count(*) AS n, sum(w)::BIGINT AS w FROM s GROUP BY 1, 2)
SELECT lang, any_value(sequences) AS sequences, any_value(lo) AS least_repeats, any_value(hi) AS most_repeats, sum(n)::BIGINT AS appearances, sum(w)::BIGINT AS exposure, count(*) AS updates, min(n) AS least_sequences, max(n) AS most_sequences, min(w) AS least_exposure, max(w) AS most_exposure FROM q JOIN r USING (lang) GROUP BY 1""")
def a20_exposure_plan(spark, d):
    return Q.exposure_plan(_scheduled(spark, d), "lang").drop("mean_repeats")


@query(_SCHEDULED + """, r AS (SELECT lang, u, max(cur) + 1 AS z, max(b + w)::BIGINT AS c FROM s GROUP BY 1, 2)
SELECT lang, u AS update, z AS cursor, c AS cumulative, c - u * 746 AS token_credit FROM r WHERE u IN (5, 10) UNION ALL SELECT DISTINCT lang, 0, 0, 0, 0 FROM s""")
def q10_resume_points(spark, d):
    return Q.resume_points(Q.update_plan(_scheduled(spark, d), 746, group="lang"), (0, 5, 10), "lang")


@query(f"SELECT 'fraction' AS name, count(*) FILTER (100 * hi <= 101 * lo) AS n FROM (SELECT max(w) AS hi, min(w) AS lo FROM (SELECT lang, sum(n_chars % 126 + 1) AS w FROM documents GROUP BY 1))")
def f10_one_percent(spark, d):
    x = _t(spark, d, "documents").groupBy("lang").agg(F.sum(F.col("n_chars") % 126 + 1).alias("w"))
    return Q.within_one_percent(x, "w").select(F.lit("fraction").alias("name"), F.col("pass").cast("long").alias("n"))


@query("SELECT l_orderkey AS update, sum(l_quantity::BIGINT)::DOUBLE / sum(l_linenumber) AS loss FROM lineitem GROUP BY 1")
def a23_normalized_loss(spark, d):
    return Q.normalized_loss(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("update"), F.col("l_quantity").cast("long").alias("numerator"), F.col("l_linenumber").alias("targets")))


@query("""
WITH g AS (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM lineitem)
SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM g GROUP BY l_orderkey, g""")
def w10_contiguity(spark, d):
    return C.runs(_t(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_linenumber")


@query(f"""
WITH {_CAT_CTE} SELECT count(*) AS n_utterances, count(DISTINCT conv_id) AS n_conversations, {", ".join(f"count(*) FILTER (cat = '{c}') AS {c}, round_even(100.0::DOUBLE * count(*) FILTER (cat = '{c}') / count(*), 4) AS pct_{c}" for c in V.CATEGORIES)} FROM c""")
def a1_category_summary(spark, d):
    x = C.annotated(_talk(spark, d)).withColumn("split", F.lit("train"))
    s = C.corpus_summary(x)
    return s.select("n_utterances", "n_conversations", *(F.col(f"count__{c}").alias(c) for c in V.CATEGORIES), *(F.col(f"pct_all__{c}").alias(f"pct_{c}") for c in V.CATEGORIES))


def _split_talk(spark, d) -> DataFrame:
    return C.annotated(_talk(spark, d)).withColumn("split", F.when(F.col("ord") % 3 == 0, "train").when(F.col("ord") % 3 == 1, "dev").otherwise("test"))


@query("""
WITH c AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split FROM conversations)
SELECT (SELECT count(*) FROM (SELECT conv_id FROM c GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS spanning, (SELECT count(*) FROM (SELECT text FROM c GROUP BY 1 HAVING count(*) > 1)) AS duplicate_texts,
  (SELECT count(*) FROM (SELECT conv_id, turn FROM c GROUP BY 1, 2 HAVING count(*) > 1)) AS duplicate_ids, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'test') AS test FROM c""")
def a2_a3_leakage_duplicates(spark, d):
    s = C.corpus_summary(_split_talk(spark, d))
    return s.select(F.col("n_conversation_ids_spanning_multiple_splits").alias("spanning"), F.col("n_duplicate_utterance_texts").alias("duplicate_texts"), F.col("n_duplicate_utterance_ids").alias("duplicate_ids"), *(F.col(f"split__{x}").alias(x) for x in ("train", "dev", "test")))


@query(f"""
WITH {_CAT_CTE}, r AS (SELECT unnest(CASE cat WHEN 'en_only' THEN ['EnglishMono', 'MonoCont', 'CsCont'] WHEN 'es_only' THEN ['SpanishMono', 'MonoCont', 'CsCont'] WHEN 'cs_within_utterance' THEN ['CsCont'] ELSE [] END) AS role FROM c)
SELECT {", ".join(f"count(*) FILTER (role = '{c}') AS {c}" for c in V.CONDITIONS)} FROM r""")
def a4_role_counts(spark, d):
    return C.corpus_summary(_split_talk(spark, d)).select(*(F.col(f"condition__{c}").alias(c) for c in V.CONDITIONS))


@query("""
WITH w AS (SELECT l_returnflag AS filename, CASE l_linestatus WHEN 'F' THEN 'eng' ELSE 'eng+spa' END AS langid FROM lineitem),
e AS (SELECT filename, 'langid' AS kind, langid AS value FROM w UNION ALL SELECT filename, 'label', CASE langid WHEN 'eng' THEN 'eng' ELSE 'mixed_morpheme' END FROM w)
SELECT filename, kind, value, count(*) AS n FROM e GROUP BY GROUPING SETS ((filename, kind, value), (kind, value))""")
def a5_ingestion_summary(spark, d):
    x = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("filename"), F.when(F.col("l_linestatus") == "F", "eng").otherwise("eng+spa").alias("langid"), F.lit("x").alias("surface"))
    return C.ingestion_summary(x)


@query("""
WITH x AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'eng' WHEN 'N' THEN 'spa' ELSE 'other' END AS s, l_linestatus = 'F' AS neutral FROM lineitem)
SELECT l_orderkey, count(*) FILTER (neutral AND s <> 'other') AS n FROM x GROUP BY 1""")
def a7_neutralized(spark, d):
    s = F.when(F.col("l_returnflag") == "A", "eng").when(F.col("l_returnflag") == "N", "spa").otherwise("other")
    x = _t(spark, d, "lineitem").select("l_orderkey", F.struct(F.when(F.col("l_linestatus") == "F", "neutral").otherwise(s).alias("a"), s.alias("b")).alias("p"))
    return x.groupBy("l_orderkey").agg(F.collect_list("p").alias("p")).select("l_orderkey", A.neutralized_count(F.col("p.a"), F.col("p.b")).cast("long").alias("n"))


@query(f"""
WITH {_CAT_CTE}, r AS (SELECT cat, cat IN ('en_only', 'es_only', 'cs_within_utterance') AS cs FROM c)
SELECT count(*) AS n_projected_utterance_rows, count(*) FILTER (cs) AS cscont_rows, count(*) FILTER (cat = 'en_only') AS unused_englishmono, count(*) FILTER (cat = 'es_only') AS unused_spanishmono,
  {", ".join(f"count(*) FILTER (cs AND cat = '{c}') AS cscont__{c}, CASE WHEN count(*) FILTER (cs) > 0 THEN round_even(100.0::DOUBLE * count(*) FILTER (cs AND cat = '{c}') / count(*) FILTER (cs), 4) ELSE 0 END AS pct_cscont__{c}" for c in V.CATEGORIES)},
  true AS check__cscont_includes_en_es_cs_rows, true AS check__monocont_excludes_cs_within_utterance, true AS check__neutral_bivalent_excluded_by_default FROM r""")
def a8_condition_manifest(spark, d):
    m = A.condition_manifest(C.annotated(_talk(spark, d)).withColumn("needs_review_mixed_morpheme", F.lit(False)))
    return m.select("n_projected_utterance_rows", "cscont_rows", "unused_englishmono", "unused_spanishmono", *(f"{p}__{c}" for c in V.CATEGORIES for p in ("cscont", "pct_cscont")), "check__cscont_includes_en_es_cs_rows", "check__monocont_excludes_cs_within_utterance", "check__neutral_bivalent_excluded_by_default")


_ROWS = "SELECT lang AS condition, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, source, n_chars AS tokens, text FROM documents"


def _split_docs(spark, d) -> DataFrame:
    r = F.col("doc_id") % 3
    return _t(spark, d, "documents").select(F.col("lang").alias("condition"), F.when(r == 0, "train").when(r == 1, "validation").otherwise("test").alias("split"), F.col("source").alias("conversation_ref"), F.col("n_chars").alias("tokens"), "text")


@query(f"""
WITH r AS ({_ROWS}), t AS (SELECT unnest(['train', 'validation', 'test']) AS split, unnest([900000, 50000, 500]) AS target), g AS (SELECT condition, split, sum(tokens)::BIGINT AS n, count(*) AS k, count(DISTINCT source) AS c FROM r GROUP BY 1, 2)
SELECT condition, split, target, greatest(1, target // 1000) AS allowed_shortfall, coalesce(n, 0) AS realized, coalesce(k, 0) AS rows, coalesce(c, 0) AS conversations, target - coalesce(n, 0) AS shortfall FROM (SELECT DISTINCT condition FROM r) CROSS JOIN t LEFT JOIN g USING (condition, split)""")
def a16_condition_balance(spark, d):
    return A.condition_balance(_split_docs(spark, d), {"train": 900_000, "validation": 50_000, "test": 500})


@query(f"""
WITH g AS (SELECT split, coalesce(sum(tokens) FILTER (condition = 'en'), 0)::BIGINT AS english, coalesce(sum(tokens) FILTER (condition = 'es'), 0)::BIGINT AS spanish FROM ({_ROWS}) GROUP BY 1)
SELECT split, english, spanish, round_even(english::DOUBLE / (english + spanish), 8) AS english_fraction, round_even(spanish::DOUBLE / (english + spanish), 8) AS spanish_fraction FROM g""")
def a16_mono_balance(spark, d):
    return A.mono_balance(A.condition_balance(_split_docs(spark, d), {"train": 1, "validation": 1, "test": 1}), "en", "es")


@query(rf"""
WITH r AS (SELECT condition AS source, split, source AS conv, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x1c-\x1f]+'), lambda t: regexp_matches(t, '\p{{L}}')))::BIGINT AS k FROM ({_ROWS}))
SELECT source, split, count(*) AS rows, count(DISTINCT conv) AS conversations, sum(k)::BIGINT AS lexical_tokens FROM r GROUP BY GROUPING SETS ((source, split), (source))""".replace("\\", "\\"))
def a17_row_manifest(spark, d):
    return A.row_manifest(_split_docs(spark, d).withColumnRenamed("condition", "source"))


@query("""
WITH o AS (SELECT CASE WHEN d.lang NOT IN ('en', 'es') THEN 'excluded' WHEN l.quality = 0 THEN 'needs_review' ELSE 'clean' END AS o FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'outcome' AS kind, v AS value, count(o) AS n FROM (SELECT unnest(['clean', 'needs_review', 'excluded']) AS v) LEFT JOIN o ON o = v GROUP BY ALL
UNION ALL SELECT 'reason', lang, count(*) FROM documents WHERE lang NOT IN ('en', 'es') GROUP BY ALL""")
def a9_a11_outcome_counts(spark, d):
    x = _t(spark, d, "documents").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    out = ~F.col("lang").isin("en", "es")
    x = x.select(F.when(out, "excluded").when(F.col("quality") == 0, "needs_review").otherwise("clean").alias("outcome"), F.when(out, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("reasons"))
    return C.outcome_counts(x, "outcome", "reasons", V.SCREENING_OUTCOMES)


@query("SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def j5_j6_conflicts(spark, d):
    return C.conflicts(_t(spark, d, "documents"), ["source"], "lang")


_ROLE_LIST = ", ".join("'" + r + "'" for r in V.SOURCE_ROLES["callhome_eng"])


@query(f"""
WITH x AS (SELECT doc_id, lang = 'en' AS known, doc_id % 2 = 0 AS ok, doc_id % 5 = 0 AS dropped FROM documents)
SELECT known AND ok AND dropped AS unexpected, NOT ok AND NOT dropped AND known AS without_eligibility, count(*) AS n FROM x GROUP BY ALL""")
def c10_c11_roles(spark, d):
    name, ok = F.when(F.col("lang") == "en", "callhome_eng").otherwise("other"), F.col("doc_id") % 2 == 0
    given = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(L.source_roles(name, F.lit(True)))
    x = _t(spark, d, "documents").select(L.role_violations(name, ok, given).alias("v"))
    return x.groupBy((F.array_contains("v", "unexpected_roles") & ~F.array_contains("v", "roles_without_eligibility")).alias("unexpected"), F.array_contains("v", "roles_without_eligibility").alias("without_eligibility")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'explicit_override' ELSE 'not_validated' END AS method, CASE WHEN doc_id % 2 = 0 THEN 'explicit_source_validation' ELSE 'not_validated' END AS reason, count(*) AS n FROM documents GROUP BY ALL")
def c13_validation(spark, d):
    v = L.validation(F.lit("eng"), F.col("doc_id") % 2 == 0)
    return _t(spark, d, "documents").groupBy(v["validation_method"].alias("method"), v["reason_codes"][0].alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, 'conv_' || substr(sha1(chr(0) || conv_id), 1, 12) AS conversation_ref, 'spk_' || substr(sha1(conv_id || chr(0) || role), 1, 12) AS speaker_ref, CASE WHEN turn % 2 = 0 THEN 'clean' ELSE 'needs_review' END AS outcome, CASE WHEN turn % 2 = 0 THEN 3 ELSE 0 END AS roles FROM conversations")
def p3_project_turns(spark, d):
    x = _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("turn_index"), F.col("role").alias("speaker_id"))
    done = x.where("turn_index % 2 = 0").select("file", "turn_index", F.lit("clean").alias("outcome"))
    y = C.project_turns(x.withColumn("conv_id", F.col("file").cast("long")), done, "eng")
    return y.join(x.select(F.col("file").cast("long").alias("conv_id"), X.safe_ref(F.col("file"), "conv").alias("conversation_ref")).distinct(), "conversation_ref").select("conv_id", F.col("turn_index").alias("turn"), "conversation_ref", "speaker_ref", "outcome", F.size("roles").alias("roles"))


@query(r"""
WITH w AS (SELECT DISTINCT lower(regexp_replace(unnest(regexp_split_to_array(text, '\s+')), '^[\p{P}\p{Z}]+|[\p{P}\p{Z}]+$', '', 'g')) AS word FROM benchmark) SELECT word FROM w WHERE word <> ''""".replace("\\", "\\"))
def x3_normalized_lexicon(spark, d):
    return A.normalize_lexicon(_t(spark, d, "benchmark").select(F.explode(X.split_words("text")).alias("word")))


@query(r"""
WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x1c-\x1f]+'), lambda t: t <> '')) AS n FROM documents) SELECT doc_id, ceil(n / 256)::BIGINT AS batches, CASE WHEN n = 0 THEN 0 ELSE (n - 1) % 256 + 1 END AS last_ FROM n""".replace("\\", "\\"))
def x14_batches(spark, d):
    b = X.batches(X.split_words("text"))
    return _t(spark, d, "documents").select("doc_id", b.alias("b")).select("doc_id", F.size("b").cast("long").alias("batches"), F.when(F.size("b") > 0, F.size(F.element_at("b", -1))).otherwise(0).cast("long").alias("last_"))


@query("""
WITH lex AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark), t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS token FROM documents),
c AS (SELECT d.doc_id, count(token) AS n, count(word) AS k FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN lex ON lex.word = t.token GROUP BY 1)
SELECT count(*) AS utterances, count(*) FILTER (n > 0 AND n = k) AS all_covered, count(*) FILTER (n > k) AS has_uncovered, count(*) FILTER (n = 0) AS no_lexical_tokens, sum(n)::BIGINT AS tokens, sum(k)::BIGINT AS covered, round_even(100.0::DOUBLE * sum(k) / sum(n), 4) AS covered_percent FROM c""")
def a18_coverage_summary(spark, d):
    return A.coverage_summary(j3_c14_coverage(spark, d))


@query("SELECT count(*) AS rows, count(*) FILTER (q = 1) AS clean, count(*) FILTER (q = 0) AS needs_review, count(*) FILTER (q IS NULL) AS excluded, count(*) FILTER (q IS NOT NULL) AS structurally_eligible FROM (SELECT l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id))")
def p11_dry_run(spark, d):
    x = _t(spark, d, "documents").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return A.dry_run_summary(x.select(F.when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "needs_review").otherwise("excluded").alias("outcome")))


@query(r"""
WITH x AS (SELECT d.lang, d.source AS conv, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: regexp_matches(t, '\p{L}')))::BIGINT AS k, coalesce(l.quality, 1) = 1 AS ok FROM documents d LEFT JOIN labels l USING (doc_id)),
p AS (SELECT lang, conv, count(*) AS n, sum(k) AS k, count(*) FILTER (ok) AS okn, coalesce(sum(k) FILTER (ok), 0) AS okk FROM x GROUP BY 1, 2)
SELECT lang AS source, sum(n)::BIGINT AS source_rows, sum(okn)::BIGINT AS eligible_rows, sum(okk)::BIGINT AS eligible_tokens, count(*) FILTER (okn < n) AS affected_conversations,
  round_even(100.0::DOUBLE * (sum(n) - sum(okn)) / sum(n), 6) AS rows_removed_percent, CASE WHEN sum(okk) > 0 THEN round_even(100.0::DOUBLE * max(okk) / sum(okk), 6) ELSE 0 END AS share FROM p GROUP BY 1""")
def a13_eligibility_summary(spark, d):
    x = _t(spark, d, "documents").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    x = x.select(F.col("lang").alias("source"), F.lit("train").alias("split"), F.col("source").alias("conversation_ref"), "text", F.when(F.coalesce("quality", F.lit(1)) != 1, V.EXCLUSION_REASONS[1]).alias("reason"))
    return C.eligibility_summary(x).select("source", "source_rows", "eligible_rows", "eligible_tokens", "affected_conversations", "rows_removed_percent", F.col("maximum_conversation_eligible_token_percent").alias("share"))


@query("""
SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'extra' WHEN l.doc_id IS NULL THEN 'missing' ELSE 'differs' END AS problem FROM (SELECT doc_id, 1 AS v FROM documents) d FULL JOIN (SELECT doc_id, quality AS v FROM labels) l ON l.doc_id = d.doc_id
WHERE l.doc_id IS NULL OR d.doc_id IS NULL OR l.v <> d.v""")
def j1_reconcile(spark, d):
    return C.reconcile(_t(spark, d, "documents").select("doc_id", F.lit(1).alias("v")), _t(spark, d, "labels").select("doc_id", F.col("quality").alias("v")), "doc_id", ["v"])


@query(r"""
WITH lex AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark), t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS token FROM documents),
c AS (SELECT d.doc_id, count(token) AS n_tokens, count(word) AS n_covered FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN lex ON lex.word = t.token GROUP BY 1)
SELECT doc_id, n_tokens, n_covered, n_tokens - n_covered AS n_uncovered, CASE WHEN n_tokens = 0 THEN 'no_lexical_tokens' WHEN n_tokens = n_covered THEN 'all_covered' ELSE 'has_uncovered' END AS outcome FROM c""")
def j3_c14_coverage(spark, d):
    words = lambda: F.explode_outer(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower))
    lex = _t(spark, d, "benchmark").select(words().alias("word")).where("word is not null")
    return C.membership(_t(spark, d, "documents").select("doc_id", words().alias("token")), lex, "doc_id")


@query("SELECT l.doc_id FROM labels l ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') e USING (doc_id)")
def j4_u2_not_subset(spark, d):
    return C.not_subset(_t(spark, d, "labels").select("doc_id"), _t(spark, d, "documents").where("lang = 'en'"), ["doc_id"])


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('7' || chr(0) || source || chr(0) || lang || chr(0) || doc_id), doc_id) AS place FROM documents")
def o3_selection_order(spark, d):
    x = _t(spark, d, "documents").select("doc_id", "lang", C.selection_key(F.col("doc_id"), F.col("source"), F.col("lang"), 7).alias("k"))
    return x.select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("k", "doc_id")).cast("long").alias("place"))


@query("""
WITH RECURSIVE o AS (SELECT lang, doc_id, n_chars AS n, row_number() OVER (PARTITION BY lang ORDER BY sha256('7' || chr(0) || source || chr(0) || lang || chr(0) || doc_id), doc_id) AS i FROM documents),
g AS (SELECT lang, 0::BIGINT AS i, 20000::BIGINT AS room, NULL::BIGINT AS doc_id FROM (SELECT DISTINCT lang FROM documents) UNION ALL
  SELECT g.lang, o.i, CASE WHEN o.n <= g.room THEN g.room - o.n ELSE g.room END, CASE WHEN o.n <= g.room AND g.room > 0 THEN o.doc_id END FROM g JOIN o ON o.lang = g.lang AND o.i = g.i + 1)
SELECT lang, doc_id FROM g WHERE doc_id IS NOT NULL""")
def o4_greedy_quota(spark, d):
    x = _t(spark, d, "documents").select("lang", F.col("doc_id").alias("row_id"), F.col("n_chars").alias("tokens"), C.selection_key(F.col("doc_id"), F.col("source"), F.col("lang"), 7).alias("key"))
    return C.greedy_quota(x, 20_000, ["lang"]).select("lang", F.col("row_id").alias("doc_id"))


@query("""
WITH p AS (SELECT text, 'benchmark' AS part, 0 AS r FROM benchmark UNION ALL SELECT text, 'documents', 1 FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY r) AS i FROM p)
SELECT part, count(*) AS n FROM o WHERE i = 1 GROUP BY 1""")
def u3_u6_priority_union(spark, d):
    side = lambda t: _t(spark, d, t).select(F.sha2("text", 256).alias("t"), F.lit(t).alias("part"))
    return C.priority_union(side("benchmark"), side("documents"), key="t").groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'xx') AS xx FROM documents) WHERE NOT (en BETWEEN 1 AND 9) AND NOT (es BETWEEN 1 AND 9) AND NOT (xx BETWEEN 1 AND 9)")
def f9_privacy_guard(spark, d):
    n = lambda c: F.count_if(F.col("lang") == c).alias(c)
    return C.releasable(_t(spark, d, "documents").agg(n("en"), n("es"), n("xx")))


@query("SELECT conv_id, sha256(string_agg(turn::VARCHAR, chr(10) ORDER BY turn)) AS sha256 FROM conversations GROUP BY 1")
def a25_ordered_checksum(spark, d):
    return C.ordered_checksum(_t(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("value")), ["conv_id"], "turn", "value")


@query("SELECT range AS update, CASE WHEN range <= 100 THEN 0.0001::DOUBLE * range / 100 ELSE 0.0001::DOUBLE * (1001 - range) / 900 END AS rate FROM range(1, 1001)")
def lr_curve(spark, d):
    return Q.learning_rates(spark)


def _packing_rows(spark, d) -> DataFrame:
    x = _t(spark, d, "conversations")
    ids = F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w: (F.pmod(F.xxhash64(w), F.lit(V.VOCABULARY - 5)) + 5).cast("int"))
    conv = F.col("conv_id").cast("string")
    none = F.lit(None).cast("string")
    rows = x.select(F.lit("MonoCont").alias("condition"), F.lit("train").alias("split"), F.lit("talk").alias("source"), F.lit("turns").alias("component"), conv.alias("document_id"), conv.alias("conversation_id"), none.alias("span_id"), none.alias("language_shard"), F.concat_ws("-", "conv_id", "turn").alias("row_id"), F.col("turn").cast("int").alias("row_order"), ids.alias("token_ids"))
    return rows


def _packed(spark, d) -> DataFrame:
    return Q.pack_rows(_packing_rows(spark, d))


@query()
def q1_q2_pack(spark, d):
    return _packed(spark, d).select("conversation_id", "sequence_index", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("ids"), "example_identity")


@query()
def q5_mask(spark, d):
    x = Q.mask_sequences(_packed(spark, d), 7)
    return x.select("example_identity", F.size("selected_positions").alias("n_targets"), "checksum_sha256")


@query()
def a19_exposure(spark, d):
    return Q.exposure(_packed(spark, d))


@query()
def q3_packed_violations(spark, d):
    return Q.packed_violations(_packed(spark, d))


@query()
def q6_validation_record(spark, d):
    return Q.validation_record(_packed(spark, d).withColumn("split", F.lit("validation")), 7)


@query()
def j8_fragment_breaks(spark, d):
    return A.fragment_breaks(_packed(spark, d), _packing_rows(spark, d))
