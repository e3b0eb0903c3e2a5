"""Tool names against globs, and JSON parameters against typed rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import any_glob, fully

#: Types a rule may ask for.  A boolean is an integer too; an integer is no float.
TYPES = ("str", "int", "float", "bool", "list", "dict")


@dataclass(frozen=True)
class ParamRule:
    """What one parameter of one tool must be; a missing or null parameter is not checked."""

    tool: str
    param: str
    types: tuple[str, ...] = ()
    max: float | None = None
    min: float | None = None
    maxlen: int | None = None
    pattern: str | None = None

    def __post_init__(self):
        if unknown := [t for t in self.types if t not in TYPES]:
            raise ValueError(f"unknown types {unknown}; known are {TYPES}")


def name_reason(name: Column, blocked: tuple[str, ...] = (), allowed: tuple[str, ...] | None = None) -> Column:
    """Why a tool's name is denied, or null: the blocklist goes first; no allowlist allows all, an empty one none."""
    out = F.when(any_glob(name, blocked), F.concat(F.lit("Tool '"), name, F.lit("' is blocked")))
    if allowed is not None:
        out = out.when(~any_glob(name, allowed), F.concat(F.lit("Tool '"), name, F.lit("' is not in the allowlist")))
    return out.otherwise(F.lit(None).cast("string"))


def json_type(value: Column) -> Column:
    """The type of a VARIANT as the rules name it; null for a missing or null value."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "BIGINT", "int")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "STRING", "str")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "dict")
    )


def _rule_reason(params: Column, rule: ParamRule) -> Column:
    value = F.try_variant_get(params, f"$['{rule.param}']" if not rule.param.isidentifier() else f"$.{rule.param}", "variant")
    kind = json_type(value)
    number = F.when(kind == "bool", F.try_variant_get(value, "$", "boolean").cast("double")).when(kind.isin("int", "float"), F.try_variant_get(value, "$", "double"))
    text = F.when(kind == "str", F.try_variant_get(value, "$", "string"))
    own = f"Param '{rule.param}'"
    checks = []
    if rule.types:
        accepted = [*rule.types, *(["bool"] if "int" in rule.types else [])]
        checks.append(F.when(kind.isNotNull() & ~kind.isin(*accepted), F.concat(F.lit(f"{own} must be {' or '.join(rule.types)}, got "), kind)))
    if rule.max is not None:
        checks.append(F.when(number > rule.max, F.lit(f"{own} exceeds max {rule.max}")))
    if rule.min is not None:
        checks.append(F.when(number < rule.min, F.lit(f"{own} below min {rule.min}")))
    if rule.maxlen is not None:
        checks.append(F.when(F.length(text) > rule.maxlen, F.lit(f"{own} exceeds maxlen {rule.maxlen}")))
    if rule.pattern is not None:
        checks.append(F.when(~fully(text, rule.pattern), F.lit(f"{own} does not match pattern")))
    return F.coalesce(*checks) if checks else F.lit(None).cast("string")


def param_reason(name: Column, params_json: Column, rules: list[ParamRule] | tuple[ParamRule, ...]) -> Column:
    """Why a call's parameters are denied, or null: rules in order, each checks type, max, min, maxlen, pattern; the first failure counts."""
    params = F.try_parse_json(params_json)
    reasons = [F.when(name == r.tool, _rule_reason(params, r)) for r in rules]
    return F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
