"""Documents from dialogues, conversations, pages, archive members and scored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash
from ..functions.text import cleaned
from .filters import safe_label

# Shown speakers, and the tags that keys and references of each source begin with.
SPEAKERS = {"USER": "Usuário", "SYSTEM": "Assistente"}
PARTICIPANT = "Participante"
PAGE_TAG, PAGE_SCORE_TAG, PAGE_DOMAIN_TAG = "wackywacky", "wackywacky-reservoir", "wackywacky-domain"
MEMBER_PREFIX, SCORED_PREFIX = "brwac:", "gigaverbo:"


def dialogue_documents(turns: DataFrame, dialogue: str, order: str, speaker: str, utterance: str, speakers: dict[str, str] | None = None) -> DataFrame:
    """(dialogue, text, turns, turns_kept): labelled lines joined in order.

    An unknown speaker is an error.  Turns that are empty after cleaning are left out,
    and a dialogue without any has a null text.
    """
    label = None
    for name, shown in (speakers or SPEAKERS).items():
        label = F.when(F.col(speaker) == name, shown) if label is None else label.when(F.col(speaker) == name, shown)
    label = label.otherwise(F.raise_error(F.concat(F.lit("unknown speaker "), F.coalesce(F.col(speaker), F.lit("null")))))
    lines = turns.select(F.col(dialogue).alias("dialogue"), F.col(order).alias("at"), label.alias("label"), cleaned(F.col(utterance)).alias("said"))
    return _joined(lines.withColumn("line", F.when(F.col("said") != "", F.concat("label", F.lit(": "), "said"))), ["dialogue"]).withColumnRenamed("n", "turns").withColumnRenamed("kept", "turns_kept")


def _joined(lines: DataFrame, key: list[str]) -> DataFrame:
    held = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("at", "line")))).alias("l"))
    return held.select(*key, F.when(F.size("l") > 0, F.array_join("l.line", "\n")).alias("text"), "n", F.size("l").cast("bigint").alias("kept"))


def conversation_documents(messages: DataFrame, conversation: str, order: str, user: str, text: str, prefix: str = PARTICIPANT) -> DataFrame:
    """(conversation, text, messages, messages_kept, participants): users become numbers in
    the order of their first message, also if that is empty after cleaning.

    First messages are minima per user and are ranked among users, not messages, so a long
    conversation of few users needs no large sort.
    """
    rows = messages.select(F.col(conversation).alias("conversation"), F.col(order).alias("at"), F.col(user).alias("user"), cleaned(F.col(text)).alias("said"))
    firsts = rows.groupBy("conversation", "user").agg(F.min("at").alias("first"))
    numbered = firsts.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("first", "user"))).alias("users"))
    numbered = numbered.select("conversation", F.size("users").cast("bigint").alias("participants"), F.posexplode("users").alias("number", "u")).select(F.col("conversation").alias("_c"), "participants", (F.col("number") + 1).alias("number"), F.col("u.user").alias("_u"))
    joined = rows.join(numbered, (F.col("conversation") == F.col("_c")) & F.col("user").eqNullSafe(F.col("_u"))).select("conversation", "at", "said", "number", "participants")
    lines = joined.withColumn("line", F.when(F.col("said") != "", F.concat(F.lit(prefix + " "), "number", F.lit(": "), "said")))
    return _joined(lines, ["conversation", "participants"]).withColumnRenamed("n", "messages").withColumnRenamed("kept", "messages_kept")


def page_keys(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Adds record_key, selection_score and domain_ref of pages (null parts count as empty)."""
    keyed = rows.withColumn("record_key", stable_hash(PAGE_TAG, F.col("id"), F.col("url_md5"), F.col("text_md5"), F.col("row_number")))
    scored = keyed.withColumn("selection_score", stable_hash(seed, PAGE_SCORE_TAG, F.col("record_key")))
    return scored.withColumn("domain_ref", stable_hash(PAGE_DOMAIN_TAG, F.when(F.coalesce(F.trim("domain_id"), F.lit("")) != "", F.col("domain_id")).otherwise(F.col("record_key"))))


def member_ref(archive: Column, member: Column) -> Column:
    return F.concat(F.lit(MEMBER_PREFIX), archive, F.lit(":"), member)


def scored_documents(rows: DataFrame, dataset: str, revision: str, config: str, split: str) -> DataFrame:
    """(stream_index, text, source_ref, source, subset) of records with a text; labels that
    aren't plain names become null."""
    ref = F.concat(F.lit(SCORED_PREFIX), stable_hash(dataset, revision, config, split, F.col("stream_index")))
    return rows.select("stream_index", cleaned(F.col("text")).alias("text"), ref.alias("source_ref"), safe_label(F.col("source")).alias("source"), safe_label(F.col("subset")).alias("subset")).filter("text <> ''")
