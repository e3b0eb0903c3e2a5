"""Personal data: extraction, redaction, masking, and reversible tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import ENTITIES
from .patterns import jvm

MODES = ("redact", "mask", "tokenize")
HIT = "array<struct<start:int,end:int,ordinal:int,entity:string>>"


def chosen(entities: list[str] | tuple[str, ...] | None) -> list[tuple[str, str]]:
    """(name, pattern) of the entities asked for, in that order; unknown names are skipped, none means all."""
    return [(e, ENTITIES[e]) for e in (entities or ENTITIES) if e in ENTITIES]


def count_of(text: Column, entity: str) -> Column:
    """How many times an entity is in a text."""
    return F.size(F.regexp_extract_all(text, F.lit(jvm(ENTITIES[entity])), F.lit(0)))


def _entity_hits(text: Column, ordinal: int, entity: str, pattern: str) -> Column:
    """Hits of one entity: the pieces between its matches and the matches, summed up to offsets."""
    matches = F.regexp_extract_all(text, F.lit(jvm(pattern)), F.lit(0))
    gaps = F.split(text, jvm(pattern), -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(HIT).alias("hits"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        hit = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(ordinal).alias("ordinal"), F.lit(entity).alias("entity"))
        return F.struct(end.alias("at"), F.concat(acc["hits"], F.array(hit)).alias("hits"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, start, step, lambda acc: acc["hits"])).otherwise(F.array().cast(HIT))


def hits(text: Column, entities=None) -> Column:
    """All hits (start, end, ordinal, entity) with offsets in code points, by start descending, ties in entity order."""
    every = F.flatten(F.array(*[_entity_hits(text, k, e, p) for k, (e, p) in enumerate(chosen(entities))]))
    keyed = F.array_sort(F.transform(every, lambda h: F.struct((-h["start"]).alias("key"), h["ordinal"].alias("ordinal"), h["start"].alias("start"), h["end"].alias("end"), h["entity"].alias("entity"))))
    return F.transform(keyed, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["ordinal"].alias("ordinal"), h["entity"].alias("entity")))


def separate(found: Column) -> Column:
    """Hits that don't overlap, by start descending: of hits that do, the leftmost, longest, first in entity order."""
    order = F.array_sort(F.transform(found, lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("less"), h["ordinal"].alias("ordinal"), h["end"].alias("end"), h["entity"].alias("entity"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(HIT).alias("kept"))

    def step(acc, h):
        hit = F.struct(h["start"].alias("start"), h["end"].alias("end"), h["ordinal"].alias("ordinal"), h["entity"].alias("entity"))
        free = h["start"] >= acc["at"]
        return F.struct(F.when(free, h["end"]).otherwise(acc["at"]).alias("at"), F.when(free, F.concat(F.array(hit), acc["kept"])).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(order, start, step, lambda acc: acc["kept"])


def token_name(session: Column, hit, original: Column, prefix: str) -> Column:
    """A hit's token: derived from session, entity, place and text, so that a rerun gives the same."""
    digest = F.sha2(F.concat_ws("|", session.cast("string"), hit["entity"], hit["start"].cast("string"), original), 256)
    return F.concat(F.lit(f"[{prefix}_"), hit["entity"], F.lit("_"), F.upper(F.substring(digest, 1, 8)), F.lit("]"))


def _span(text: Column, hit) -> Column:
    return F.substring(text, hit["start"] + 1, hit["end"] - hit["start"])


def rewrite(text: Column, found: Column, mode: str, session: Column | None = None, prefix: str = "TOK") -> Column:
    """The text with every hit (by start descending) replaced.

    Offsets are of the original text.  With hits that overlap, a replacement cuts into one made before it, as
    the offsets then no longer fit; ``separate`` avoids that.
    """

    def replacement(hit):
        if mode == "mask":
            return F.repeat(F.lit("*"), hit["end"] - hit["start"])
        if mode == "tokenize":
            return token_name(session, hit, _span(text, hit), prefix)
        return F.concat(F.lit("[REDACTED_"), hit["entity"], F.lit("]"))

    def step(acc, hit):
        return F.concat(F.substring(acc, F.lit(1), hit["start"]), replacement(hit), F.substring(acc, hit["end"] + 1, F.length(acc)))

    return F.aggregate(found, text, step)


def redact_chained(text: Column, entities=None) -> Column:
    """Redaction by one replacement after the other, in whole-stage code: exact where hits don't overlap."""
    return reduce(lambda t, e: F.regexp_replace(t, jvm(e[1]), f"[REDACTED_{e[0]}]"), chosen(entities), text)


def kinds_hit(text: Column, entities=None) -> Column:
    """How many of the entities are in a text at all; below two nothing can overlap between entities."""
    return reduce(lambda a, b: a + b, [text.rlike(jvm(p)).cast("int") for _, p in chosen(entities)], F.lit(0))


def transform(text: Column, mode: str = "redact", entities=None, overlap: str = "separate", session: Column | None = None, prefix: str = "TOK") -> Column:
    """The rewritten text, or null where nothing changes.

    ``overlap``: ``separate`` keeps the leftmost of hits that overlap; ``compat`` applies every hit with offsets
    of the original text.  Redaction takes the offsets' path only where two entities are in the text.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    if overlap not in ("separate", "compat"):
        raise ValueError(f"overlap {overlap!r} is neither 'separate' nor 'compat'")
    if mode == "tokenize" and session is None:
        raise ValueError("tokenize needs the session's column")
    found = hits(text, entities)
    exact = rewrite(text, separate(found) if overlap == "separate" else found, mode, session, prefix)
    if mode == "redact":
        exact = F.when(kinds_hit(text, entities) >= 2, exact).otherwise(redact_chained(text, entities))
    else:
        exact = F.when(kinds_hit(text, entities) >= 1, exact).otherwise(text)
    return F.nullif(exact, text)


def found(text: Column, entities=None) -> Column:
    """The hits that don't overlap; none are looked for where no entity is in the text."""
    return F.when(kinds_hit(text, entities) >= 1, separate(hits(text, entities))).otherwise(F.array().cast(HIT))


def tokens(text: Column, session: Column, own: Column, prefix: str = "TOK") -> Column:
    """(token, original, ordinal) of hits (``found``) that ``rewrite`` in tokenize mode replaces, in the order of replacement."""
    return F.transform(own, lambda h, i: F.struct(token_name(session, h, _span(text, h), prefix).alias("token"), _span(text, h).alias("original"), i.alias("ordinal")))


#: Score from which on an engine's hit counts.
THRESHOLD = 0.6


def engine_hits(text: Column, engine, entities=None, threshold: float = THRESHOLD) -> Column:
    """Hits by a named-entity engine, as ``hits`` gives those of the patterns.

    ``engine`` is a function without arguments that a worker calls once; what it returns takes a text and gives
    (start, end, entity, score) tuples with offsets in code points.  Entities that weren't asked for don't count.
    """
    wanted = None if entities is None else frozenset(entities)

    @F.pandas_udf(HIT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        analyse = engine()
        for texts in batches:
            out = []
            for t in texts:
                own = [] if t is None else [h for h in analyse(t) if h[3] >= threshold and (wanted is None or h[2] in wanted)]
                out.append([{"start": a, "end": b, "ordinal": k, "entity": e} for k, (a, b, e, _) in enumerate(own)])
            yield pd.Series(out)

    return run(text)


def detokenize(text: Column, known: Column) -> Column:
    """Every known token (array of token, original) replaced by its original, one pass each, in order."""
    return F.aggregate(known, text, lambda acc, t: F.replace(acc, t["token"], t["original"]))


def resolve(known: Column, token: Column) -> Column:
    """The original of one token, or null."""
    return F.try_element_at(F.map_from_entries(F.transform(known, lambda t: F.struct(t["token"], t["original"]))), token)
