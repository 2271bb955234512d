"""Manifests, balances, scans of whole folders, lexicon protocol and model-input rows: aggregates and checks over the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text as X
from ..sources import readers as R
from .corpus import quota_tolerance

# --- summaries --------------------------------------------------------------


def neutralized_count(labels: Column, source_labels: Column) -> Column:
    """Places labelled neutral whose source label was a language."""
    return F.size(F.filter(F.zip_with(labels, source_labels, lambda a, b: (a == "neutral") & b.isin("eng", "spa")), lambda x: x))


def sample_summary(rows: DataFrame) -> DataFrame:
    """One row: utterances, category counts, neutralized tokens, rows with switches, and three checks that hold of every row."""
    cat, labels = F.col("language_category"), F.col("token_language_labels")
    n = F.size(labels)
    holds = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    return rows.agg(
        F.count("*").alias("n_utterances"), *(F.count_if(cat == c).alias(f"count__{c}") for c in V.CATEGORIES),
        F.coalesce(F.sum(neutralized_count(labels, F.col("source_token_language_labels"))), F.lit(0)).cast("long").alias("n_neutralized_disfluency_tokens"),
        F.count_if(F.coalesce("is_inter_sentential_switch_from_previous", F.lit(False))).alias("n_rows_with_switch"),
        holds(n == F.size("source_token_language_labels")).alias("check__labels_aligned"),
        holds(F.forall(labels, lambda x: x.isin(*V.TOKEN_LABELS))).alias("check__labels_known"),
        holds(cat.isin(*V.CATEGORIES)).alias("check__categories_known"),
    )


def condition_manifest(rows: DataFrame) -> DataFrame:
    """One row of category and role counts, the share that the code-switched condition takes, proportions and six checks."""
    cat, roles, review = F.col("language_category"), F.col("condition_candidates"), F.col("needs_review_mixed_morpheme")
    cs, has = F.array_contains(roles, "CsCont"), lambda c: F.array_contains(roles, c)
    whenever = lambda when, then: F.coalesce(F.bool_and(~when | then), F.lit(True))
    one = rows.agg(
        F.count("*").alias("n_projected_utterance_rows"), F.count_distinct("conversation_id").alias("n_conversations"),
        *(F.count_if(cat == c).alias(f"count__{c}") for c in V.CATEGORIES), *(F.count_if(has(c)).alias(f"candidates__{c}") for c in V.CONDITIONS),
        F.count_if(cs).alias("cscont_rows"), *(F.count_if(cs & (cat == c)).alias(f"cscont__{c}") for c in V.CATEGORIES), F.count_if(cs & review).alias("cscont_needs_review"),
        F.count_if((cat == "en_only") & has("EnglishMono")).alias("unused_englishmono"), F.count_if((cat == "es_only") & has("SpanishMono")).alias("unused_spanishmono"),
        whenever(cat == "cs_within_utterance", ~has("MonoCont")).alias("check__monocont_excludes_cs_within_utterance"),
        whenever(review, ~has("MonoCont")).alias("check__monocont_excludes_mixed_morpheme_review"),
        whenever(review, F.size(F.array_except(roles, F.array(F.lit("CsCont")))) == 0).alias("check__mixed_morpheme_rows_cscont_only"),
        whenever(cat.isin(*V.LANGUAGE_CATEGORIES), cs).alias("check__cscont_includes_en_es_cs_rows"),
        whenever(cat.isin("punctuation_or_empty", "mixed_or_uncertain", "metadata_or_noise"), F.size(roles) == 0).alias("check__excluded_categories_have_no_conditions"),
        whenever(cat == "neutral_or_bivalent", F.size(roles) == 0).alias("check__neutral_bivalent_excluded_by_default"),
    )
    return one.withColumns({
        **{f"pct_all__{c}": X.percent(F.col(f"count__{c}"), F.col("n_projected_utterance_rows")) for c in V.CATEGORIES},
        **{f"pct_cscont__{c}": X.percent(F.col(f"cscont__{c}"), F.col("cscont_rows")) for c in V.CATEGORIES},
    })


def transcript_summary(chat: dict[str, DataFrame], n_files: int) -> DataFrame:
    """(measure, key, n): headers by transcripts that have them, tiers by prefix, and totals. Header values are never read."""
    u, tiers, headers = chat["utterances"], chat["tiers"], chat["headers"]
    total = lambda df, name, c=None: df.agg((F.count("*") if c is None else F.count_distinct(c)).alias("n")).select(F.lit(name).alias("measure"), F.lit("").alias("key"), "n")
    by_key = headers.groupBy(F.col("marker").alias("key")).agg(F.count_distinct("file").alias("n")).select(F.lit("header").alias("measure"), "key", "n")
    by_tier = tiers.groupBy(F.col("prefix").alias("key")).agg(F.count("*").alias("n")).select(F.lit("tier").alias("measure"), "key", "n")
    files = u.sparkSession.range(1).select(F.lit("n_files").alias("measure"), F.lit("").alias("key"), F.lit(n_files).cast("long").alias("n"))
    parts = [
        by_tier, files, total(u, "n_utterances"), total(chat["warnings"], "n_parser_warnings"), total(tiers, "n_files_with_dependent_tiers", "file"), total(u.where("media_id is not null"), "n_utterances_with_media_id"),
        total(headers.where("marker = '@Languages'"), "n_files_with_languages_header", "file"), total(headers.where("marker = '@Media'"), "n_files_with_media_header", "file"),
    ]
    out = by_key
    for p in parts:
        out = out.unionByName(p)
    return out


def condition_balance(rows: DataFrame, targets: dict[str, int], group: str = "condition") -> DataFrame:
    """Per condition and split of the targets: realized tokens, shortfall, what may be short, rows and conversations; also without rows."""
    spark = rows.sparkSession
    plan = spark.createDataFrame([(s, t, quota_tolerance(t)) for s, t in targets.items()], "split string, target long, allowed_shortfall long")
    real = rows.groupBy(group, "split").agg(F.sum("tokens").alias("realized"), F.count("*").alias("rows"), F.count_distinct("conversation_ref").alias("conversations"))
    x = rows.select(group).distinct().crossJoin(F.broadcast(plan)).join(real, [group, "split"], "left").fillna(0, ["realized", "rows", "conversations"])
    return x.withColumn("shortfall", F.col("target") - F.col("realized"))


def mono_balance(balance: DataFrame, english: str, spanish: str, group: str = "condition") -> DataFrame:
    """Each split's tokens of two shards and their shares."""
    n = lambda c: F.coalesce(F.sum(F.when(F.col(group) == c, F.col("realized"))), F.lit(0))
    x = balance.groupBy("split").agg(n(english).alias("english"), n(spanish).alias("spanish"))
    share = lambda c: F.when(F.col("english") + F.col("spanish") > 0, F.bround(F.col(c) / (F.col("english") + F.col("spanish")), 8)).otherwise(0.0)
    return x.withColumn("english_fraction", share("english")).withColumn("spanish_fraction", share("spanish"))


def row_manifest(rows: DataFrame) -> DataFrame:
    """Rows, conversations and lexical tokens per source and split, and per source."""
    x = rows.withColumn("tokens", X.lexical_count("text").cast("long"))
    return x.groupingSets([["source", "split"], ["source"]], "source", "split").agg(F.count("*").alias("rows"), F.count_distinct("conversation_ref").alias("conversations"), F.sum("tokens").alias("lexical_tokens"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """One row of utterance and token totals over ``membership`` rows; an empty population raises."""
    n = F.count("*")
    return covered.agg(
        F.when(n > 0, n).otherwise(F.raise_error(F.lit("an empty population has no coverage"))).alias("utterances"), *(F.count_if(F.col("outcome") == o).alias(o) for o in V.COVERAGE_OUTCOMES),
        F.sum("n_tokens").alias("tokens"), F.sum("n_covered").alias("covered"), X.percent(F.sum("n_covered"), F.sum("n_tokens")).alias("covered_percent"),
    )


def dry_run_summary(decisions: DataFrame) -> DataFrame:
    """Rows by outcome, and those that are structurally eligible, which are all but the excluded."""
    return decisions.agg(F.count("*").alias("rows"), *(F.count_if(F.col("outcome") == o).alias(o) for o in V.SCREENING_OUTCOMES), F.count_if(F.col("outcome") != "excluded").alias("structurally_eligible"))


# --- folders and strict files -----------------------------------------------


def list_files(spark: SparkSession, folder: str, pattern: str = "*.cha", expected: int | None = None) -> list[str]:
    """The folder's own files that match, sorted by name; links and a wrong number are refused."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path) or []
    if any(s.isSymlink() for s in found):
        raise ValueError("links are refused")
    names = sorted(str(s.getPath()) for s in found if s.isFile())
    if expected is not None and len(names) != expected:
        raise ValueError(f"{len(names)} files, not {expected}")
    return names


def tolerant_scan(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """The permissive scan of the files without violations, and ``failed``, the others with theirs."""
    failed = R.chat_violations(spark, paths)
    bad = {r[0] for r in failed.select("file").distinct().collect()}  # one name a refused file
    good = [p for p in paths if p.rsplit("/", 1)[-1] not in bad]
    return R.read_chat(spark, good or paths) | {"failed": failed} if good else {"failed": failed}


def read_strict_chat(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """The rows of files that pass every gate of the strict reader, continuations joined; any violation raises."""
    first = R.chat_violations(spark, paths).orderBy("file").first()
    if first:
        raise ValueError(f"{first['file']}: {first['violation']}")
    return R.read_chat(spark, paths, joined=True)


def strict_jsonl_violations(spark: SparkSession, paths) -> DataFrame:
    """(file, line, problem): lines that are no JSON object, and files whose last line has no end."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    end = raw.where("value != '' and not endswith(value, '\n')").select("file", F.lit(None).cast("int").alias("line"), F.lit("no final newline").alias("problem"))
    each = R.lines(spark, paths)
    object_ = F.col("value").rlike(r"\A\s*\{") & F.try_parse_json("value").isNotNull()
    return each.where(~F.coalesce(object_, F.lit(False))).select("file", F.col("line").cast("int").alias("line"), F.lit("no JSON object").alias("problem")).unionByName(end)


def word_list_violations(spark: SparkSession, paths, sha256: str | None = None) -> DataFrame:
    """(file, problem): a word list must end in LF, hold no CR, NUL, blank or spaced entry, ascend strictly by bytes and have its digest."""
    raw = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "content", F.col("content").cast("string").alias("text"))
    entries = F.split(F.regexp_replace("text", "\n\\z", ""), "\n")
    rules = {
        "carriage return or NUL": F.col("text").rlike("[\r\\x00]"), "no final newline": ~F.col("text").endswith("\n"),
        "blank or spaced entry": F.exists(entries, lambda w: (w == "") | w.rlike("[ \t]")),
        "not strictly ascending": F.exists(F.zip_with(F.slice(entries, F.lit(2), F.greatest(F.size(entries) - 1, F.lit(0))), F.slice(entries, F.lit(1), F.size(entries) - 1), lambda b, a: ~(F.hex(a.cast("binary")) < F.hex(b.cast("binary")))), lambda x: x),
        "other digest": F.lit(False) if sha256 is None else F.sha2("content", 256) != sha256,
    }
    return raw.select("file", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("problem"))


# --- lexicon and checker protocol -------------------------------------------


def normalize_lexicon(words: DataFrame, word: str = "word") -> DataFrame:
    """The distinct normalized words, without empties."""
    return words.select(X.normalize_token(X.nfc_text(F.col(word))).alias(word)).where(F.col(word) != "").distinct()


def checker_input(tokens: Column) -> Column:
    """What a checker in pipe mode reads, a caret before each token."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("^"), t, F.lit("\n"))), "")


def checker_verdicts(response: Column, tokens: Column, heading: str) -> Column:
    """One exact bool a token from a pipe-mode response: a heading, then a record and an empty line for each token; any other framing raises."""
    body = F.substring(response, len(heading) + 1, 2**31 - 1)
    parts = F.split(body, "\n\n")
    fits = response.startswith(heading) & (F.size(parts) == F.size(tokens) + 1) & (F.element_at(parts, -1) == "")
    # Accepting and rejecting records.
    verdict = lambda r, t: F.when(r.rlike(r"^(\*|\+ \S+|-)$"), True).when(r.startswith(F.concat(F.lit("# "), t, F.lit(" "))) | r.startswith(F.concat(F.lit("& "), t, F.lit(" "))), False)
    found = F.zip_with(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), tokens, verdict)
    return F.when(fits & ~F.exists(found, lambda v: v.isNull()), found).otherwise(F.raise_error(F.lit("unexpected checker response")))


# --- model-input rows -------------------------------------------------------


def without_text(rows: DataFrame, text_columns=("text", "clean_text", "raw_main_tier_text", "tokens")) -> DataFrame:
    """Provenance only; nothing that holds a transcript's words."""
    return rows.drop(*text_columns)


def checked_rows(rows: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Typed rows of known sources with their lexical counts; an unknown source, split or stated count that differs raises.

    A count of zero is only allowed where every token is punctuation.
    """
    n = X.lexical_count("text").cast("long")
    said = F.col("lexical_tokens").cast("long") if "lexical_tokens" in rows.columns else n
    only_marks = F.forall(X.split_words("text"), lambda t: t.rlike(r"^[\p{P}\p{S}]+$"))
    fault = (
        F.when(~F.col("source").isin(*sources), "unknown source").when(~F.col("split").isin(*V.POOL_SPLITS), "unknown split")
        .when(said != n, "another lexical count").when((n == 0) & ~only_marks, "no lexical token")
    )
    return rows.withColumn("lexical_tokens", F.when(fault.isNull(), n).otherwise(F.raise_error(fault)))


def packing_inputs(rows: DataFrame, token_ids: str, key: bytes) -> DataFrame:
    """Packing rows with HMAC pseudonyms; a monolingual document is its conversation, a natural span its own document, only MonoCont has a shard."""
    name = X.hmac_hex(key)
    conversation, span = F.col("conversation_ref").cast("string"), F.col("span_id").cast("string") if "span_id" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        "condition", "split", "source", F.coalesce(F.col("component") if "component" in rows.columns else F.lit(None), F.col("condition")).alias("component"),
        name(F.coalesce(span, conversation)).alias("document_id"), name(conversation).alias("conversation_id"), F.when(span.isNotNull(), name(span)).alias("span_id"),
        F.when(F.col("condition") == "MonoCont", F.col("source")).alias("language_shard"), name(F.col("row_id").cast("string")).alias("row_id"), F.col("turn_index").cast("int").alias("row_order"), F.col(token_ids).alias("token_ids"),
    )


def fragment_breaks(packed: DataFrame, rows: DataFrame) -> DataFrame:
    """Source rows whose packed fragments don't run from 0 to their length without a gap or overlap, or that have none."""
    keys = ["condition", "split", "source", "row_id"]
    parts = packed.select("condition", "split", "source", F.explode("provenance").alias("p")).select("condition", "split", "source", "p.*")
    w = Window.partitionBy(*keys).orderBy("source_start")
    parts = parts.withColumn("expected", F.coalesce(F.lag("source_end").over(w), F.lit(0)))
    ends = parts.groupBy(*keys).agg(F.bool_and(F.col("expected") == F.col("source_start")).alias("runs"), F.max("source_end").alias("covered"))
    x = rows.select(*keys, F.size("token_ids").alias("n")).join(ends, keys, "full_outer")
    return x.where("n is null or coalesce(covered, 0) != n or not coalesce(runs, true)").select(*keys, F.when(F.col("n").isNull(), "extra").when(F.col("covered").isNull(), "missing").otherwise("broken").alias("problem"))


def training_only(packed: DataFrame, expected: dict[str, int]) -> DataFrame:
    """F8: the training sequences; a condition whose number differs from the expected raises."""
    counts = packed.where("split = 'train'").groupBy("condition").agg(F.count("*").alias("n"))
    wrong = F.lit(False)
    for c, n in expected.items():
        wrong |= (F.col("condition") == c) & (F.col("n") != n)
    checked = counts.withColumn("n", F.when(wrong | ~F.col("condition").isin(*expected), F.raise_error(F.lit("unexpected number of sequences"))).otherwise(F.col("n")))
    return packed.where("split = 'train'").join(F.broadcast(checked.where("n >= 0").select("condition")), "condition", "left_semi")


def preparation_order(rows: DataFrame, ranks: dict[str, int], block: str = "component") -> DataFrame:
    """Rows by the rank of their block, then role, then ordinal."""
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair)), F.col(block))
    return rows.withColumn("block_rank", rank).orderBy("block_rank", "role", "ordinal")
