"""Audit files, and notifications of approval gates."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.audit import hmac_sha256, line


def write_audit(df: DataFrame, record: Column, path: str, mode: str = "append") -> None:
    """Audit records as JSON lines under ``path``."""
    df.select(line(record).alias("value")).write.mode(mode).text(path)


def stream_audit(df: DataFrame, record: Column, path: str, checkpoint: str):
    """The same for a stream; returns the running query."""
    return df.select(line(record).alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def chat_text(gate: Column, kind: Column, details: list[tuple[str, Column]]) -> Column:
    """A gate's lines for a chat channel; absent details have no line."""
    head = [F.concat(F.lit("*Approval required* `"), gate, F.lit("`")), F.concat(F.lit("*type*: "), kind)]
    return F.concat_ws("\n", *head, *[F.concat(F.lit(f"*{name}*: "), value.cast("string")) for name, value in details])


def chat_payload(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("text")))


def webhook_body(gate: Column, context: list[tuple[str, Column]]) -> Column:
    return F.to_json(F.struct(gate.alias("gate_id"), *[c.alias(n) for n, c in context]), {"ignoreNullFields": "false"})


def webhook_signature(body: Column, secret: bytes) -> Column:
    """The value of a signature header: ``sha256=`` and the HMAC of the body."""
    return F.concat(F.lit("sha256="), hmac_sha256(secret, body))


class Notifier(Protocol):
    """Sends gates; done when sent, not when answered."""

    def __call__(self, gates: DataFrame, batch_id: int) -> None: ...


class ConsoleNotifier:
    """Prints every gate with its context and how to answer it."""

    def __init__(self, out: Callable[[str], None] = print):
        self.out = out

    def __call__(self, gates: DataFrame, batch_id: int) -> None:
        for row in gates.toLocalIterator():
            self.out("\n".join([f"[gate] {row['gate_id']}", *[f"  {k}: {v}" for k, v in row.asDict().items() if k != "gate_id" and v is not None], f"  approve({row['gate_id']!r}) or deny({row['gate_id']!r})"]))


class HttpNotifier:
    """Posts each gate's body from the executors, ten seconds at most each; raises on an error status.

    ``secret`` signs the body in the header ``header``.  ``post`` may replace the transport.
    """

    def __init__(self, url: str, secret: bytes | None = None, header: str = "X-Signature", post: Callable[[str, bytes, dict], int] | None = None):
        self.url, self.secret, self.header, self.post = url, secret, header, post

    def requests(self, gates: DataFrame) -> DataFrame:
        """(body, signature) of every gate; the signature is null without a secret."""
        context = [(c, F.col(c)) for c in gates.columns if c != "gate_id"]
        bodies = gates.select(webhook_body(F.col("gate_id"), context).alias("body"))
        return bodies.withColumn("signature", webhook_signature(F.col("body"), self.secret) if self.secret else F.lit(None).cast("string"))

    def __call__(self, gates: DataFrame, batch_id: int) -> None:
        url, header, post = self.url, self.header, self.post or _post

        def send(rows: Iterable) -> None:
            for row in rows:
                headers = {"Content-Type": "application/json"} | ({header: row["signature"]} if row["signature"] else {})
                status = post(url, row["body"].encode(), headers)
                if status >= 400:
                    raise OSError(f"{url} answered {status}")

        self.requests(gates).foreachPartition(send)


def _post(url: str, body: bytes, headers: dict) -> int:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, data=body, headers=headers), timeout=10) as answer:
        return answer.status


