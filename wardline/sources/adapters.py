"""Messages out of the shapes that agent frameworks keep them in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import last_row

#: Fields that may hold a crew's question, in order of preference.
QUESTION_FIELDS = ("query", "input", "topic", "task")


def graph_state(conversations: DataFrame, *, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last message of every conversation, whoever wrote it."""
    return last_row(conversations, key, [order])


def chat_request(conversations: DataFrame, *, key: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """The last message of every conversation, if the user wrote it."""
    return last_row(conversations, key, [order]).where(F.col(role) == "user")


def crew_inputs(inputs_json: Column) -> Column:
    """The first field of a JSON object, of those a question may be in, that holds a string."""
    value = F.try_parse_json(inputs_json)
    found = []
    for name in QUESTION_FIELDS:
        own = F.try_variant_get(value, f"$.{name}", "variant")
        found.append(F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(own, "$", "string")))
    return F.coalesce(*found)


def as_messages(df: DataFrame, *, session: str, order: str, text: str, role: str | None = None, ts: str | None = None) -> DataFrame:
    """(session_id, seq, direction, text, ts): a user's rows are inputs, an assistant's outputs, others are left out."""
    direction = F.lit("input") if role is None else F.when(F.col(role) == "user", "input").when(F.col(role) == "assistant", "output")
    at = F.lit(None).cast("timestamp") if ts is None else F.col(ts).cast("timestamp")
    return df.select(F.col(session).cast("string").alias("session_id"), F.col(order).cast("bigint").alias("seq"), direction.alias("direction"), F.col(text).alias("text"), at.alias("ts")).where("direction is not null")


def fold_of(key: Column, folds: int = 5) -> Column:
    """A row's fold by the hash of its key: the same in every run, and 0 is the test fold."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(folds))


def labelled(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(key, text, label, is_test): labelled texts with a split by hash, a fifth for the test."""
    return documents.join(labels.select(key, F.col(label).alias("label")), key).select(key, "text", "label", (fold_of(F.col(key)) == 0).alias("is_test"))
