"""Tool calls against tool rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.toolcheck import name_reason, param_reason
from ..plans.policies import NAME_CODE, PARAM_CODE, ToolRules


def verdict(tool: Column, params: Column, rules: ToolRules) -> tuple[Column, Column, Column]:
    """(reason code, reason, warning) of a call; names go first, and a denied name's parameters are not looked at."""
    name = name_reason(tool, rules.blocked, rules.allowed)
    param = param_reason(tool, params, rules.params)
    reason, nothing = F.coalesce(name, param), F.lit(None).cast("string")
    if rules.mode == "warn":
        return nothing, nothing, reason
    return F.when(name.isNotNull(), NAME_CODE).when(param.isNotNull(), PARAM_CODE), reason, nothing


def check_calls(calls: DataFrame, rules: ToolRules, *, tool: str = "tool_name", params: str = "params") -> DataFrame:
    """``calls`` with allowed, reason_code, reason and warning."""
    code, reason, warning = verdict(F.col(tool), F.col(params), rules)
    return calls.select(*calls.columns, code.isNull().alias("allowed"), code.alias("reason_code"), F.when(code.isNotNull(), reason).alias("reason"), warning.alias("warning"))
