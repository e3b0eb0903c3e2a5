"""Injection rules over a text and what it hides, and canary tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decoding import scan_text
from .fixed_values import INJECTION_RULES, RULE_CATEGORIES
from .patterns import found, jvm

#: Characters of a rule that a reason shows.
SHOWN = 60


def first_rule(text: Column, custom: tuple[str, ...] = ()) -> Column:
    """Number (from 1) of the first rule found in the text, custom rules after the built-in ones; null for none.

    One alternation decides most texts, which match nothing, before rules are told apart.
    """
    rules = [*INJECTION_RULES, *custom]
    flags = ["iU"] * len(INJECTION_RULES) + ["imU"] * len(custom)
    either = text.rlike("|".join(f"(?:{jvm(r)})" for r in INJECTION_RULES))
    for r in custom:
        either = either | found(text, r, "imU")
    return F.when(either, F.coalesce(*[F.when(found(text, r, f), F.lit(n)) for n, (r, f) in enumerate(zip(rules, flags), 1)]))


def with_rule(df: DataFrame, text: Column, custom: tuple[str, ...] = (), name: str = "rule") -> DataFrame:
    """``df`` with ``first_rule`` over the text followed by what it hides; the scanned text is a column of its own, made once for all rules."""
    scanned = df.withColumn("_scan", scan_text(text))
    return scanned.withColumn(name, first_rule(F.col("_scan"), custom)).drop("_scan")


def rule_reason(rule: Column, custom: tuple[str, ...] = ()) -> Column:
    """The reason that names a rule."""
    shown = F.array(*[F.lit(f"Matched pattern: '{r[:SHOWN]}'") for r in [*INJECTION_RULES, *custom]])
    return F.when(rule.isNotNull(), F.element_at(shown, rule))


def rule_category(rule: Column) -> Column:
    """The category of a built-in rule; ``custom`` for the others."""
    out = F.when(rule.isNull(), F.lit(None).cast("string"))
    for name, last in RULE_CATEGORIES:
        out = out.when(rule <= last, F.lit(name))
    return out.otherwise(F.lit("custom"))


def canary(session: Column, salt: str, prefix: str = "CANARY") -> Column:
    """The session's canary: a prefix and 16 hex capitals, the same in every run with the same salt."""
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha2(F.concat(session.cast("string"), F.lit("|" + salt)), 256), 1, 16)))


def with_canary(prompt: Column, token: Column) -> Column:
    """A system prompt that carries a canary in a comment."""
    return F.concat(prompt, F.lit("\n\n<!-- "), token, F.lit(" -->"))


def leaks(output: Column, token: Column) -> Column:
    """Whether an output has the session's canary; never where there is none."""
    return F.coalesce(F.contains(output, token), F.lit(False))
