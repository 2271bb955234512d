"""Scans: word-level TSV, CHAT transcripts, word lists, JSONL, the toy corpus."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text as X
from ..schema import UTTERANCE


def lines(spark: SparkSession, paths) -> DataFrame:
    """(file, line, value): every physical line in file order, without its line end."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return raw.select("file", F.posexplode(F.split(F.regexp_replace("value", "\n\\z", ""), "\n")).alias("line", "value")).withColumn("value", F.regexp_replace("value", "\r+\\z", ""))


def read_words(spark: SparkSession, paths) -> DataFrame:
    """Word rows in file order (``line``). Bad integers fail under ANSI mode."""
    x = lines(spark, paths).withColumn("kind", _line_kind(F.col("value"))).where("kind = 'word'")
    f = F.split("value", "\t")
    stem = F.regexp_replace(F.regexp_replace("file", r"\.[^.]*$", ""), "_cgwords", "")
    cols = [F.coalesce(F.get(f, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(V.WORD_COLUMNS)]
    x = x.select("file", "line", *cols, stem.alias("__stem"))
    for c in ("word_id", "utterance_id", "location"):
        x = x.withColumn(c, F.col(c).cast("int"))
    return x.withColumn("filename", F.when(F.col("filename") == "", F.col("__stem")).otherwise(F.col("filename"))).drop("__stem")


def _line_kind(value):
    bare = F.trim(value)
    return F.when(bare.rlike(r"(?U)^\s*$"), "blank").when(bare.rlike(r"^\(\d+ rows\)$"), "footer").when(F.split(value, "\t")[0] == V.WORD_COLUMNS[0], "header").otherwise("word")


def word_file_counters(spark: SparkSession, paths) -> DataFrame:
    """Skipped blank and footer lines per file."""
    x = lines(spark, paths).withColumn("kind", _line_kind(F.col("value")))
    return x.groupBy("file").agg(F.count_if(F.col("kind") == "blank").alias("n_skipped_blank"), F.count_if(F.col("kind") == "footer").alias("n_skipped_footer"))


def group_words(words: DataFrame) -> DataFrame:
    """O1: one row per utterance, words ordered by location, then by line; ``ord`` is the first line."""
    w = words.groupBy("filename", "utterance_id").agg(F.min("line").alias("ord"), F.array_sort(F.collect_list(F.struct("location", "line", "surface", "langid", "speaker"))).alias("w"))
    return w.select(
        F.col("filename").alias("conversation_id"), F.col("utterance_id").alias("source_utterance_id"), X.global_utterance_id(F.col("filename"), F.col("utterance_id")).alias("utterance_id"),
        F.col("w")[0]["speaker"].alias("speaker_id"), F.col("w.surface").alias("tokens"), F.col("w.langid").alias("langids"), F.array_join("w.surface", " ").alias("text"), "ord",
    )


def read_chat(spark: SparkSession, paths, joined: bool = False) -> dict[str, DataFrame]:
    """Permissive CHAT scan: utterances, dependent tiers, headers, warnings; ``joined`` takes a tier with its continuations as one line."""
    x = (logical_lines if joined else lines)(spark, paths).where(F.trim("value") != "")
    w = Window.partitionBy("file").orderBy("line")
    first = F.substring("value", 1, 1)
    kind = F.when(first == "@", "header").when(first == "*", "main").when(first == "%", "tier").otherwise("unknown")
    marker, value = X.split_marker(F.col("value"))
    x = x.withColumn("kind", kind).withColumn("marker", marker).withColumn("payload", value)
    x = x.withColumn("turn_index", F.sum((F.col("kind") == "main").cast("int")).over(w) - 1)
    x = x.withColumn("language", F.last(F.when((F.col("kind") == "header") & (F.col("marker") == "@Languages"), F.coalesce(X.first_language(F.col("payload")), F.lit(""))), ignorenulls=True).over(w))
    tiers = x.where("kind = 'tier' and turn_index >= 0").select("file", "turn_index", "line", F.col("marker").alias("prefix"), F.col("payload").alias("value"))
    media = tiers.where(F.col("prefix").isin("%snd", "%mov")).groupBy("file", "turn_index").agg(F.max_by("value", "line").alias("media_id"))
    by_turn = tiers.groupBy("file", "turn_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "prefix", "value"))), lambda t: F.struct(t["prefix"].alias("prefix"), t["value"].alias("value"))).alias("dependent_tiers"))
    main = x.where("kind = 'main'").select("file", "turn_index", F.trim(F.substring("marker", 2, 1_000_000)).alias("speaker_id"), F.col("payload").alias("raw_main_tier_text"), F.nullif("language", F.lit("")).alias("language"))
    utterances = main.join(by_turn, ["file", "turn_index"], "left").join(media, ["file", "turn_index"], "left")
    headers = x.where("kind = 'header'").groupBy("file", "marker").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "payload"))), lambda t: t["payload"]).alias("values"))
    bad = x.where("kind = 'unknown' or (kind = 'tier' and turn_index < 0)")
    warnings = bad.select("file", (F.col("line") + 1).alias("line"), F.when(F.col("kind") == "tier", "orphan dependent tier").when(F.col("value").rlike(r"(?U)^\s"), "continuation line").otherwise("unknown line").alias("warning"))
    return {"utterances": utterances, "tiers": tiers, "headers": headers, "warnings": warnings}


def chat_violations(spark: SparkSession, paths) -> DataFrame:
    """(file, violation) of the strict reader's gates, in their order; files without a row are valid."""
    raw = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "content")
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string")
    raw = raw.withColumn("text", text).withColumn("ls", F.split("text", "\r?\n"))
    tail = F.filter("ls", lambda v: v.startswith(" "))
    owned = F.exists(F.sequence(F.lit(0), F.size("ls") - 1), lambda i: F.col("ls")[i].startswith("\t") & ((i == 0) | F.when(i > 0, F.get("ls", i - 1) == "").otherwise(False) | F.col("ls")[i].rlike(r"^\t[\t ]|^\t\s*$")))
    verdict = (
        F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", "byte order mark").when(F.col("text").isNull(), "invalid UTF-8").when(F.col("text").contains("�"), "replacement character")
        .when((F.size(tail) > 0) | owned, "invalid continuation").when(F.col("ls")[0] != "@UTF8", "missing UTF8 header")
        .when(F.exists("ls", lambda v: (v != "") & ~v.rlike("^[@*%\t]")), "unknown tier")
    )
    return raw.select("file", verdict.alias("violation")).where("violation is not null")


def logical_lines(spark: SparkSession, paths) -> DataFrame:
    """Tiers with their TAB continuations joined by one space."""
    x = lines(spark, paths)
    w = Window.partitionBy("file").orderBy("line")
    x = x.withColumn("owner", F.sum(F.col("value").rlike("^[@*%]").cast("int")).over(w)).where("value != '' and owner > 0")
    parts = x.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("p"))
    n = F.size("p")
    piece = F.transform("p", lambda s, i: F.when(i < n - 1, F.regexp_replace(F.regexp_replace(s["value"], "^\t", ""), "[ \t]+$", "")).otherwise(F.regexp_replace(s["value"], "^\t", "")))
    return parts.select("file", F.col("p")[0]["line"].alias("line"), F.array_join(piece, " ").alias("value"))


def read_word_list(spark: SparkSession, paths, dictionary: bool = False) -> DataFrame:
    """Distinct words; a dictionary drops an all-digit first line and what follows a slash."""
    x = lines(spark, paths)
    if dictionary:
        x = x.where(~((F.col("line") == 0) & F.trim("value").rlike(r"^\d+$"))).withColumn("value", F.substring_index("value", "/", 1))
    return x.select(F.trim("value").alias("word")).where("word != '' and not startswith(word, '#')").distinct()


def read_utterances(spark: SparkSession, paths) -> DataFrame:
    """JSONL of utterance rows; malformed lines fail."""
    return spark.read.schema(UTTERANCE).option("mode", "FAILFAST").json(paths)


def read_unsealed(spark: SparkSession, paths, schema, splits=("train", "validation")) -> DataFrame:
    """Records of the given splits; the text of other records is never decoded."""
    raw = spark.read.text(paths).where(F.get_json_object("value", "$.split").isin(*splits))
    return raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


# The toy corpus.
TOY = (
    ("u001", "Hello, how are you doing today?", "conv01", "spk1"),
    ("u002", "I want to go to the store for some coffee.", "conv01", "spk2"),
    ("u004", "Hola, como estas hoy?", "conv01", "spk1"),
    ("u005", "Quiero un cafe por favor.", "conv01", "spk2"),
    ("u003", "The dog ran very fast yesterday.", "conv02", "spk1"),
    ("u006", "El perro corrio muy rapido ayer.", "conv02", "spk1"),
    ("u018", "Buenos dias, gracias mucho.", "conv06", "spk1"),
    ("u017", "Good morning, thanks very much.", "conv06", "spk1"),
    ("u007", "I want una empanada please.", "conv03", "spk1"),
    ("u008", "Hola friend, are you going to la fiesta?", "conv03", "spk2"),
    ("u009", "The perro ran rapido to la escuela today.", "conv03", "spk1"),
    ("u010", "Maria Netflix.", "conv04", "spk1"),
    ("u011", "Okay Juan.", "conv04", "spk2"),
    ("u012", "...", "conv04", "spk1"),
    ("u013", "", "conv04", "spk2"),
    ("u014", "Xyzzy blorp fnord.", "conv05", "spk1"),
    ("u015", "[laughs]", "conv05", "spk2"),
    ("u016", "SPEAKER1:", "conv05", "spk1"),
)


def toy_utterances(spark: SparkSession) -> DataFrame:
    """The literal utterances with their order."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(TOY)], "utterance_id string, text string, conversation_id string, speaker_id string, ord int")


def shuffled_splits(keys: list[str], seed: int, train: float = 0.6, dev: float = 0.2, need_all: bool = False) -> dict[str, str]:
    """Splits by a seeded shuffle of the given keys, on the driver: the shuffle is a fixed generator's."""
    order = list(keys)
    random.Random(seed).shuffle(order)
    a, b = round(len(order) * train), round(len(order) * dev)
    if need_all and min(a, b, len(order) - a - b) < 1:
        raise ValueError("these fractions leave a split empty")
    return {k: "train" if i < a else "dev" if i < a + b else "test" for i, k in enumerate(order)}
