"""Python checks of texts that fail closed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(check: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A column function: (reason, failed) of ``check`` on each text; an exception is a failure of its row alone."""

    def one(text: str | None) -> tuple[str | None, bool]:
        if text is None:
            return None, False
        try:
            reason = check(text)
            return None if reason is None else str(reason), False
        except Exception:  # noqa: BLE001 - whatever a user's check raises blocks the row
            return None, True

    @F.pandas_udf("reason string, failed boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["reason", "failed"])

    return run
