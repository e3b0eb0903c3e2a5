"""Policies as immutable specifications.  Their order in a chain is significant."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from ..functions.toolcheck import ParamRule


@dataclass(frozen=True)
class Policy:
    """A policy takes part only in the directions that it names: ``input``, ``output``, ``tool``."""

    @property
    def directions(self) -> tuple[str, ...]:
        return ()


@dataclass(frozen=True)
class PromptRules(Policy):
    """Blocks inputs by rule, and outputs that leak the session's canary."""

    custom: tuple[str, ...] = ()
    use_canary: bool = False
    canary_salt: str = ""
    canary_prefix: str = "CANARY"
    #: A scored tier after the rules: a column function of the text, from 0 to 1; from ``sensitivity`` on it blocks.
    scorer: Callable[[Column], Column] | None = None
    sensitivity: float = 0.85
    #: Whether a text without a score is blocked.
    fail_closed: bool = True

    @property
    def directions(self):
        return ("input", "output") if self.use_canary else ("input",)


@dataclass(frozen=True)
class PersonalData(Policy):
    """Rewrites inputs, never blocks; in tokenize mode outputs get their originals back."""

    mode: str = "redact"
    entities: tuple[str, ...] | None = None
    overlap: str = "separate"
    prefix: str = "TOK"
    #: A named-entity engine in place of the patterns (see ``functions.pii.engine_hits``), and its least score.
    engine: Callable | None = None
    threshold: float = 0.6

    def __post_init__(self):
        if self.mode not in ("redact", "mask", "tokenize"):
            raise ValueError(f"mode {self.mode!r} is none of redact, mask, tokenize")

    @property
    def directions(self):
        return ("input", "output") if self.mode == "tokenize" else ("input",)


@dataclass(frozen=True)
class CostLimit(Policy):
    """Meters inputs and outputs; in block mode an input that would pass the budget is denied and not metered."""

    max_usd: float = 1.0
    model: str = "gpt-4o"
    mode: str = "block"
    per: str = "session"
    prices: tuple[tuple[str, float, float], ...] = ()
    #: Counts a text's tokens; the native estimate where there is none.
    counter: Callable[[Column], Column] | None = None

    def __post_init__(self):
        if self.mode not in ("block", "warn") or self.per not in ("session", "global"):
            raise ValueError("mode is 'block' or 'warn', per is 'session' or 'global'")

    @property
    def directions(self):
        return ("input", "output")


@dataclass(frozen=True)
class RateLimit(Policy):
    """A token bucket over inputs: ``per_minute`` tokens a minute, at most ``burst``."""

    per_minute: float = 60.0
    burst: int = 1
    per: str = "session"

    def __post_init__(self):
        if self.per_minute <= 0:
            raise ValueError("per_minute must be positive")
        if self.per not in ("session", "global"):
            raise ValueError("per is 'session' or 'global'")
        object.__setattr__(self, "burst", max(1, self.burst))

    @property
    def directions(self):
        return ("input",)


@dataclass(frozen=True)
class ToolRules(Policy):
    """Tool names by globs, parameters by typed rules; in warn mode everything passes with a warning."""

    blocked: tuple[str, ...] = ()
    allowed: tuple[str, ...] | None = None
    params: tuple[ParamRule, ...] = ()
    mode: str = "block"

    @property
    def directions(self):
        return ("tool",)


@dataclass(frozen=True)
class Approval(Policy):
    """Calls and inputs that a person must approve: triggers ``tool_call:<glob>``, ``cost_exceeds:<usd>``, ``pii_detected``."""

    triggers: tuple[str, ...] = ()
    timeout_seconds: float = 300.0
    on_timeout: str = "deny"

    def __post_init__(self):
        if self.on_timeout not in ("allow", "deny"):
            raise ValueError("on_timeout is 'allow' or 'deny'")

    @property
    def directions(self):
        return ("input", "tool")


@dataclass(frozen=True)
class Audit(Policy):
    """Records what reaches it, with the text as rewritten before it."""

    hashed: bool = True

    @property
    def directions(self):
        return ("input", "output", "tool")


@dataclass(frozen=True)
class Custom(Policy):
    """A user's policy: column functions of the text, each giving a reason (null allows) or a new text (null keeps).

    ``check`` is the same as ``block`` for a plain function of a string, run in Arrow batches; where it raises, the row is
    blocked.  Column functions should be total (``try_`` functions): an error in one is an error of the whole job.
    """

    name: str = "custom"
    block: Callable[[Column], Column] | None = None
    rewrite: Callable[[Column], Column] | None = None
    check: Callable[[str], str | None] | None = None
    on: tuple[str, ...] = ("input",)
    code: str = "INPUT_BLOCKED"
    params: dict = field(default_factory=dict, hash=False, compare=False)

    @property
    def directions(self):
        return self.on


# Reason codes.
CODES = {
    PromptRules: "PROMPT_INJECTION_DETECTED",
    CostLimit: "COST_LIMIT_EXCEEDED",
    RateLimit: "RATE_LIMIT_EXCEEDED",
    Approval: "HUMAN_GATE_DENIED",
}
ML_CODE, CANARY_CODE = "PROMPT_INJECTION_DETECTED_ML", "CANARY_TRIGGERED"
NAME_CODE, PARAM_CODE, ERROR_CODE = "TOOL_NOT_ALLOWED", "TOOL_PARAM_INVALID", "SHIELD_ERROR"
