"""Secret scan: base patterns, and assignment-aware lexing of source and configuration syntax.

The lexer reads name-literal pairs out of a text: assignments (``x = "..."``, ``x := ...``, ``x: str = ...``),
mapping entries (``"key": "..."``, ``key => ...``, YAML and INI lines, command-line options), elements
(``<key>...</key>``) and URL credentials.  Right-hand sides are literals, names, and concatenations of both;
a name stands for the constant last assigned to it, so a literal that reaches a sensitive name through other
names counts too, and its span is where the literal stands.  Every literal is scored by what its targets' names
say (``db_password``, ``apiKey``, but not ``password_hint``) and by how much it looks like a generated value.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Kinds in the order in which spans of equal start stand.
KINDS = ("assign", "access", "hex", "named")
#: A literal from this score on is a secret.
THRESHOLD = 0.75

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX_RUN = re.compile(r"[0-9a-f]{16,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Fewest characters: of an assignment's value and of an access key.
ASSIGN_CHARS, ACCESS_CHARS = 12, 18

# A name begins at a boundary, and nothing that is matched is given back, so that a text of any shape takes linear time.
_TARGET = re.compile(r"""(?<![\w$.\-])(["'`]?)-{0,2}([A-Za-z_$][\w$.\-]*+)(?<![.\-])\1[ \t]*+(?:\[[^\[\]\n]*+\][ \t]*+)?(:=|=>|=(?!=)|:(?!:|//|=))[ \t]*+""", re.ASCII)
_TYPE = r"[A-Za-z_][\w.]*+(?:\[[\w.,| \[\]]*+)?"
_ANNOTATION = re.compile(rf"{_TYPE}(?:[ \t]*+\|[ \t]*+{_TYPE})*+[ \t]*+=(?!=)[ \t]*+", re.ASCII)
_OPERAND = re.compile(r"""[rRbBuUfF]{0,2}(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)|([A-Za-z_$][\w$]*+(?:\.[\w$]++)*+)(?![\w$+/=.\-@!#%^&*(])""", re.ASCII)
_PLUS = re.compile(r"[ \t]*+(?:\+|\.\.)[ \t]*+")
_BARE = re.compile(r"""[^\s"'`,;<>{}()\[\]]++""")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*+)(?:\s[^<>]*+)?>([^<>\n]++)</\1\s*+>", re.ASCII)
_URL = re.compile(r"://[^\s/:@'\"]*+:([^\s/@'\"]++)@", re.ASCII)
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: How much a word of a name says; pairs of adjacent words come first.
_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("secret", "key"): 1.0, ("private", "key"): 1.0, ("auth", "key"): 1.0, ("signing", "key"): 1.0, ("encryption", "key"): 1.0, ("master", "key"): 1.0, ("client", "key"): 0.9, ("account", "key"): 0.9, ("connection", "string"): 0.8}
_SINGLE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "secrets": 0.9, "token": 0.95, "apikey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "privatekey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "authtoken": 1.0, "pass": 0.85, "auth": 0.8, "authorization": 0.8}
#: A name that ends in one of these is about a secret, and isn't one.
_ABOUT = frozenset("hint field label length len size type name id file path url uri regex pattern policy prompt reset expires expiry ttl count min max required enabled env variable var header placeholder limit manager provider store".split())
_PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|-+|change.?me|example|sample|dummy|test|todo|none|null|nil|true|false|undefined|your[-_ ].*|my[-_ ].*|<.*>|\$\{.*\}?|\$\(.*|\{\{.*|%\(.*|\[.*\]|\$[A-Za-z_]\w*|enter[-_ ].*|insert[-_ ].*|placeholder|password|secret|token)$")


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def base_spans(text: str) -> list[tuple[Span, int]]:
    """(span, where its secret begins) of the base patterns: of each kind the leftmost matches that don't overlap, less those too short."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(Span(m.start(), 0, m.end()), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(Span(m.start(), 1, m.end()), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    # A match of [0-9a-f]+ is a maximal run, so asking for sixteen at once finds the same ones.
    found += [(Span(m.start(), 2, m.end()), m.start()) for m in _HEX_RUN.finditer(text)]
    return found


def name_weight(name: str) -> float:
    """How surely a name says that its value is a secret, from 0 to 1."""
    words = [w.lower() for w in _NAME_WORD.findall(name)]
    if not words or words[-1] in _ABOUT or "public" in words:
        return 0.0
    return max([_PAIRS.get(p, 0.0) for p in zip(words, words[1:])] + [_SINGLE.get(w, 0.0) for w in words])


def literal_weight(value: str, quoted: bool) -> float:
    """How much a literal looks like a generated value, from 0 to 1; an unquoted one needs two kinds of characters."""
    return 0.0 if _PLACEHOLDER.match(value) else Literal(0, len(value), quoted).measure(value).weight()


class Literal:
    """A literal of the text, or a concatenation of such: what its value is like, without the value.

    A concatenation only points to its parts, so constants that grow by and by take no more than a step each.
    """

    __slots__ = ("chars", "end", "first", "found", "parts", "quoted", "size", "spaced", "start")

    def __init__(self, start: int, end: int, quoted: bool, parts: tuple = ()):
        self.start, self.end, self.quoted, self.parts = start, end, quoted, parts
        self.chars: Counter | None = None
        self.found = False

    def measure(self, value: str) -> Literal:
        self.chars, self.size, self.first = Counter(value), len(value), value[:2]
        self.spaced = any(c.isspace() for c in self.chars)
        return self

    def weight(self) -> float:
        if self.size < 6 or self.spaced:
            return 0.0
        kinds = sum((any(c.islower() for c in self.chars), any(c.isupper() for c in self.chars), any(c.isdigit() for c in self.chars), any(not c.isalnum() for c in self.chars)))
        titled = self.first[:1].isupper() and sum(n for c, n in self.chars.items() if not c.islower()) == 1
        if kinds < 2 + (not self.quoted and titled) and (not self.quoted or self.size < 12):
            return 0.0
        entropy = -sum(c / self.size * math.log2(c / self.size) for c in self.chars.values())
        return min(1.0, entropy / 2.6) * min(1.0, self.size / 8)


def joined(parts: list[Literal], text: str) -> Literal:
    """The concatenation of literals; one that recurs counts once."""
    parts = list({id(p): p for p in parts}.values())
    for p in parts:
        if p.chars is None:
            p.measure(text[p.start : p.end])
    if len(parts) == 1:
        return parts[0]
    out = Literal(0, 0, all(p.quoted for p in parts), tuple(parts))
    out.chars = sum((p.chars for p in parts), Counter())
    out.size, out.spaced, out.first = sum(p.size for p in parts), any(p.spaced for p in parts), next((p.first for p in parts if p.first), "")
    if out.size > 1 << 40:
        # Doubling over and over: only the shares of the characters matter.
        out.chars = Counter({c: max(1, n >> 20) for c, n in out.chars.items()})
        out.size = out.chars.total()
    return out


def pairs(text: str) -> list[tuple[str, Literal]]:
    """(target name, what reaches it) in order, constants propagated."""
    out: list[tuple[str, Literal]] = []
    known: dict[str, Literal | None] = {}
    if "=" in text or ":" in text:
        at = 0
        while (m := _TARGET.search(text, at)) is not None:
            at = m.end()
            name = m[2]
            if m[3] == ":" and (a := _ANNOTATION.match(text, at)):
                at = a.end()
            literals, end = _expression(text, at, known)
            at = max(at, end)
            known[name] = joined(literals, text) if literals else None
            if literals:
                out.append((name, known[name]))
    if "</" in text:
        out += [(m[1], joined([Literal(m.start(2), m.end(2), True)], text)) for m in _ELEMENT.finditer(text)]
    if "://" in text:
        out += [("password", joined([Literal(m.start(1), m.end(1), True)], text)) for m in _URL.finditer(text)]
    return out


def _expression(text: str, at: int, known: dict[str, Literal | None]) -> tuple[list[Literal], int]:
    """The literals of the expression at ``at``, and where it ends."""
    literals: list[Literal] = []
    first = True
    while True:
        if (m := _OPERAND.match(text, at)) is None:
            if first and (b := _BARE.match(text, at)):
                return [] if text[b.end() : b.end() + 1] == "(" else [Literal(b.start(), b.end(), False)], b.end()
            return literals, at
        if m[4] is None:
            g = next(k for k in (1, 2, 3) if m[k] is not None)
            literals.append(Literal(m.start(g), m.end(g), True))
        elif m[4] in known:
            if (own := known[m[4]]) is not None:
                literals.append(own)
        elif first:
            # An unknown name is a bare value of a configuration, unless more follows.
            if _PLUS.match(text, m.end()) is None:
                return [Literal(m.start(4), m.end(4), False)], m.end()
        first = False
        at = m.end()
        if (plus := _PLUS.match(text, at)) is None:
            return literals, at
        at = plus.end()


def named_spans(text: str) -> list[Span]:
    """Spans of literals that reach a sensitive name, by the method above.

    A literal that is a placeholder scores nothing by itself; of a concatenation, the whole is scored.
    """
    found = set()
    for name, value in pairs(text):
        if value.found or not (weight := name_weight(name)) or weight * value.weight() < THRESHOLD:
            continue
        if not value.parts and _PLACEHOLDER.match(text[value.start : value.end]):
            continue
        # Every part is walked once, however many constants hold it.
        waiting = [value]
        while waiting:
            one = waiting.pop()
            if not one.found:
                one.found = True
                waiting += one.parts
                if not one.parts and one.end > one.start:
                    found.add(Span(one.start, 3, one.end))
    return sorted(found)


def all_spans(text: str) -> tuple[list[Span], list[Span], list[tuple[int, int]]]:
    """(base spans, base and named spans, ranges of the secrets themselves), each sorted; base spans stay whatever the method finds.

    A named span adds nothing, and is left out, where it lies within the base spans' secrets; one that reaches
    further than they do stays.
    """
    base = sorted(base_spans(text))
    own = [s for s, _ in base]
    ranges = [(at, s.end) for s, at in base]
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    more = []
    for s in named_spans(text) if "=" in text or ":" in text or "</" in text else ():
        before = bisect_right(starts, s.start)
        if not before or merged[before - 1][1] < s.end:
            more.append(s)
    return own, sorted(own + more), sorted(ranges + [(s.start, s.end) for s in more])


def rendered(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, ranges: list[tuple[int, int]], mark: str) -> str:
    """The text with every range of secrets replaced; ranges that touch or overlap are one."""
    parts, at = [], 0
    for start, end in ranges:
        if start >= at:
            parts += [text[at:start], mark]
            at = end
        else:
            at = max(at, end)
    return "".join([*parts, text[at:]])


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_named.

    Offsets are code points, ends exclusive; a null text is empty, and an empty text has no spans.  Null ids and
    repeated rows stay; other columns of the input are not read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in slices(batches):
            rows = []
            for raw in batch.column(1).to_pylist():
                base, every, _ = all_spans((raw or b"").decode("utf-8", "replace"))
                n = Counter(s.kind for s in every)
                rows.append((n[0], n[1], n[2], hashlib.sha256(rendered(base).encode()).hexdigest(), rendered(every), n[3]))
            c = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[i], pa.int64()) for i in range(3)), pa.array(c[3], pa.string()), pa.array(c[4], pa.string()), pa.array(c[5], pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_named bigint")


def redact(df: DataFrame, *, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The input's rows and columns, with secrets in the text replaced by ``mark`` and ``chars_col``, if there, counted anew.

    No row goes.  A null text stays null; a text without secrets stays as it is.
    """
    names = df.columns
    at, count = names.index(text_col), names.index(chars_col) if chars_col in names else -1

    def run(batches):
        for batch in slices(batches):
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            for i, text in enumerate(texts):
                if text:
                    texts[i] = redacted(text, all_spans(text)[2], mark)
            columns[at] = pa.array(texts, columns[at].type)
            if count >= 0:
                old = columns[count].to_pylist()
                columns[count] = pa.array([o if t is None else len(t) for o, t in zip(old, texts)], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)
