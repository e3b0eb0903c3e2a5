"""Token counts and prices."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed_values import PRICES

#: Tokens of a model whose name doesn't begin so are so many times those of its stand-in tokenizer.
OWN_TOKENIZER, FACTOR = "gpt-", 1.3
PER_TOKENS = 1_000_000.0


def estimated_tokens(text: Column) -> Column:
    """The native counter: a token for every four characters, rounded up."""
    return F.ceil(F.length(text) / F.lit(4.0)).cast("bigint")


#: A rank file beyond this is no vocabulary to ship to every worker.
MAX_RANK_FILE = 64 << 20
_ENCODINGS: dict = {}


def bpe_counter(spark: SparkSession, ranks: str, pattern: str, special: tuple[str, ...] = ("<|endoftext|>",)) -> Callable[[Column], Column]:
    """A counter of byte-level BPE tokens by the vocabulary at ``ranks`` (lines of base64 token and rank), in Arrow batches.

    A text with the string of a special token has no count, so that a budget blocks it; neither has a null text.
    """
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(ranks)
    if system.get_file_info(at).size > MAX_RANK_FILE:
        raise ValueError(f"{ranks} is larger than {MAX_RANK_FILE} bytes")
    with system.open_input_stream(at) as f:
        data = f.read()
    shared = spark.sparkContext.broadcast(data)
    key = (hashlib.sha256(data).hexdigest(), pattern)

    def encoding():
        import tiktoken

        if key not in _ENCODINGS:
            own = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line.strip())}
            _ENCODINGS.clear()
            _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own, special_tokens={})
        return _ENCODINGS[key]

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoding()
        for texts in batches:
            yield pd.Series([None if t is None or any(s in t for s in special) else len(own.encode_ordinary(t)) for t in texts], dtype="Int64")

    return count


def scaled_tokens(tokens: Column, model: Column) -> Column:
    """Tokens as another tokenizer would count them, truncated."""
    return F.when(model.startswith(OWN_TOKENIZER), tokens).otherwise((tokens * F.lit(FACTOR)).cast("bigint"))


def price_table(spark: SparkSession, own: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(model, input, output): the price book, with a user's entries in place of whole ones."""
    rows = [(m, float(i), float(o)) for m, (i, o) in (PRICES | (own or {})).items()]
    return spark.createDataFrame(rows, "model string, input double, output double")


def with_rate(df: DataFrame, prices: DataFrame, model: str = "model", direction: str = "direction") -> DataFrame:
    """``df`` with ``rate``: dollars a million tokens for the row's model and direction; an unlisted model costs as "unknown".

    The price book has a row for each model and is made on the driver, so it is broadcast.
    """
    book = prices.select(F.col("model").alias("_model"), F.col("input").alias("_in"), F.col("output").alias("_out"))
    listed = book.alias("b")
    unknown = book.where("_model = 'unknown'").select(F.col("_in").alias("_uin"), F.col("_out").alias("_uout"))
    # One row at most: the cross with it adds two constant columns.
    joined = df.join(F.broadcast(listed), df[model] == F.col("_model"), "left").join(F.broadcast(unknown))
    rate = F.when(F.col(direction) == "input", F.coalesce("_in", "_uin")).otherwise(F.coalesce("_out", "_uout"))
    return joined.withColumn("rate", rate).drop("_model", "_in", "_out", "_uin", "_uout")


def cost(tokens: Column, rate: Column) -> Column:
    return tokens / F.lit(PER_TOKENS) * rate


def rate_literal(model: str, own: dict[str, tuple[float, float]] | None = None) -> tuple[float, float]:
    """(input, output) dollars a million tokens of one model."""
    book = PRICES | (own or {})
    return tuple(map(float, book.get(model, book["unknown"])))
