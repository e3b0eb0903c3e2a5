"""The token map of reversible redaction: made from inputs, joined to outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pii


def token_map(messages: DataFrame, *, session: str = "session_id", order: str = "seq", text: str = "text", entities=None, prefix: str = "TOK") -> DataFrame:
    """(session, token, original, order, ordinal) of every token that the messages' rewriting makes."""
    # The hits are a column of their own, so that they are found once for all that is made of them.
    hit = messages.withColumn("_hits", pii.found(F.col(text), entities)).where(F.size("_hits") > 0)
    found = hit.select(F.col(session), F.col(order), F.explode(pii.tokens(F.col(text), F.col(session), F.col("_hits"), prefix)).alias("t"))
    return found.select(session, "t.token", "t.original", order, F.col("t.ordinal").alias("ordinal"))


def restore(outputs: DataFrame, tokens: DataFrame, *, row: list[str], session: str = "session_id", text: str = "text", prefix: str = "TOK", name: str = "restored") -> DataFrame:
    """``outputs`` with ``name``: the text with its session's tokens replaced by their originals.

    Only tokens that stand in a text are looked up, so a session's whole map is never gathered.  ``row`` are
    columns that tell the outputs apart.
    """
    shape = rf"\[{prefix}_[A-Z_]+_[0-9A-F]{{8}}\]"
    seen = outputs.select(*row, session, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(shape), F.lit(0)))).alias("token"))
    known = tokens.groupBy(session, "token").agg(F.min("original").alias("original"))
    maps = seen.join(known, [session, "token"]).groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("token", "original"))).alias("_known"))
    joined = outputs.join(maps, row, "left")
    return joined.withColumn(name, F.when(F.col("_known").isNull(), F.col(text)).otherwise(pii.detokenize(F.col(text), F.col("_known")))).drop("_known")
