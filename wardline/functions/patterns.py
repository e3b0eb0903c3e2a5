"""Regular expressions and globs of the policies, as the JVM must be given them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def jvm(pattern: str, flags: str = "iU") -> str:
    r"""A pattern written for Unicode-aware matching, ignoring case.

    ``(?U)`` gives ``\w \d \b`` their Unicode meaning and ``\s`` is widened by U+001C..U+001F, which count as
    white space where the patterns come from.
    """
    out, in_class, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(r"\s\x1c-\x1f" if in_class else r"[\s\x1c-\x1f]")
            k += 2
        elif two == r"\S" and not in_class:
            out.append(r"[^\s\x1c-\x1f]")
            k += 2
        elif two[:1] == "\\":
            out.append(two)
            k += 2
        else:
            c = pattern[k]
            if c == "[" and not in_class:
                in_class = True
                out.append("[")
                k += 1
                if pattern[k : k + 1] == "^":
                    out.append("^")
                    k += 1
                if pattern[k : k + 1] == "]":
                    out.append(r"\]")
                    k += 1
                continue
            if c == "[":
                out.append(r"\[")  # a plain bracket inside a class; the JVM would nest one
            else:
                if c == "]":
                    in_class = False
                out.append(c)
            k += 1
    return f"(?{flags})" + "".join(out)


def found(text: Column, pattern: str, flags: str = "iU") -> Column:
    """Whether the pattern is anywhere in the text."""
    return text.rlike(jvm(pattern, flags))


def fully(text: Column, pattern: str) -> Column:
    r"""Whether the pattern matches the whole text; ``\z``, since ``$`` also matches before a last newline."""
    return text.rlike(rf"\A(?:{jvm(pattern, 'U')})\z")


def glob_regex(glob: str) -> str:
    """A shell glob (``* ? [seq] [!seq]``) over a whole name, case-sensitive, as a JVM pattern."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        k += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = k + (glob[k : k + 1] == "!")
            end += glob[end : end + 1] == "]"
            while end < len(glob) and glob[end] != "]":
                end += 1
            if end >= len(glob):
                out.append(r"\[")
                continue
            body = glob[k:end]
            k = end + 1
            negate, body = body[:1] == "!", body.removeprefix("!")
            out.append("[" + "^" * negate + re.sub(r"([\\\[\]^&~])", r"\\\1", body) + "]")
        else:
            out.append(re.escape(c))
    return r"(?s)\A" + "".join(out) + r"\z"


def any_glob(name: Column, globs: list[str] | tuple[str, ...]) -> Column:
    """Whether any of the globs matches the name; never for no globs."""
    result = F.lit(False)
    for glob in globs:
        result = result | name.rlike(glob_regex(glob))
    return result
