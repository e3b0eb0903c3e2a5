"""Substring dedup by hashing: passages that stand in more than one place are kept once, where they rank first.

Units are normalised (letter case and white space) and hashed; digests are grouped over the whole corpus, and of each
the occurrence of the lowest (document, place) is the one that stays.  There are two kinds of units:

* *Lines* (or paragraphs).  Adjacent lines whose earliest occurrences are adjacent in one document, too, are a chain,
  and a chain of ``MIN_WORDS`` words or more is a repeated passage: it stands earlier as it is, line for line.
* *Runs of words*, since most repeated passages begin and end inside a line.  In every ``MIN_WORDS`` words the run of half
  as many with the smallest hash is a mark; equal passages have equal marks, so only around marks that several places
  have are the runs of ``MIN_WORDS`` words looked at, and those of them that stand earlier go.

A passage therefore always stands earlier as a whole: lines that are repeated one here, one there, are none.
Spans are offsets into the original text.

The groups are aggregates with map-side combining, so a line that a third of all documents share is one row a
task; the occurrences then meet their group in an equi-join, whose large partitions adaptive execution splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, slices, worker_memo, written

#: Fewest words of a repeated passage.
MIN_WORDS = 50
#: So many documents' plans are broadcast at most, to fetch the texts whose runs are compared; each has at most PLAN_MARKS marks.
BROADCAST_PLANS, PLAN_MARKS = 20_000, 200
#: Bits of the map of planned documents that keeps other texts out of that join's shuffle: 8 MB, whatever their number.
PLAN_BITS = 1 << 26
#: Words whose hashes a worker remembers.
WORD_MEMO = 300_000
#: Places looked at together when marks are chosen.
BLOCK = 1 << 16

UNITS = "doc_id bigint, version bigint, n_words int, lines array<struct<place:int,lo:int,hi:int,start:int,stop:int,digest:bigint,check:bigint>>, marks array<struct<at:int,mark:bigint>>"
RUN = "key bigint, check bigint, doc_id bigint, version bigint, at int, start int, stop int"
SPAN = ["doc_id", "version", "start", "end", "n_words", "first_doc_id"]

_PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n\s*)?\n")
# Two odd multipliers, for hashes of runs of words that are independent of each other.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Hashes(dict):
    """64-bit hashes of words, made on demand."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        value = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < WORD_MEMO:
            self[word] = value
        return value


class _Powers:
    """Powers of the bases and of their inverses, as far as texts have needed them."""

    def __init__(self):
        self.size = 0

    def upto(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.size < n:
            self.size = max(n, 2 * self.size, 1 << 12)
            self.pairs = [tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(self.size - 1, x, np.uint64)])) for x in (b, pow(b, -1, 1 << 64))) for b in _BASES]
        return self.pairs


_HASHES, _POWERS = worker_memo(_Hashes()), _Powers()


class Words:
    """The normalised words of a text: digests of any of its runs of words in one step each."""

    def __init__(self, text: str):
        found = text.lower().split()
        self.n = len(found)
        hashes = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, self.n)
        self._powers = _POWERS.upto(self.n + 1)
        self._sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * p[: self.n], dtype=np.uint64)]) for p, _ in self._powers]

    def digests(self, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
        """Hashes of the runs [lo, hi) as signed integers."""
        sums, inverse = self._sums[which], self._powers[which][1]
        x = (sums[hi] - sums[lo]) * inverse[lo]
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        return (x ^ x >> np.uint64(33)).view(np.int64)

    def marks(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes): of the runs of half ``size`` words in each run of ``size``, the one of the smallest hash, the first of several."""
        half = (size + 1) // 2
        reach = size - half + 1
        if self.n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(self.n - half + 1)
        hashes = self.digests(at, at + half, 0)
        chosen = []
        for k in range(0, len(hashes) - reach + 1, BLOCK):
            part = np.lib.stride_tricks.sliding_window_view(hashes[k : k + BLOCK + reach - 1], reach)
            chosen.append(np.unique(part.argmin(1) + np.arange(k, k + len(part))))
        places = np.unique(np.concatenate(chosen))
        return places, hashes[places]


def lines_of(text: str, unit: str = "line") -> list[tuple[int, int, int]]:
    """(start, stop, words) of the units of a text that have words, without the white space around them."""
    out, at = [], 0
    cuts = [(m.start(), m.end()) for m in _PARAGRAPH.finditer(text)] if unit == "paragraph" else [(k, k + 1) for k in _newlines(text)]
    for end, nxt in [*cuts, (len(text), len(text))]:
        line = text[at:end]
        if n := len(line.split()):
            out.append((at + len(line) - len(line.lstrip()), at + len(line.rstrip()), n))
        at = nxt
    return out


def _newlines(text: str) -> Iterator[int]:
    k = text.find("\n")
    while k >= 0:
        yield k
        k = text.find("\n", k + 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("doc_id is not null and text is not null")


def _lists(sizes: list[int], **columns) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    values = [pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)) for kind, parts in columns.values()]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(values, names=list(columns)))


def unit_table(df: DataFrame, *, min_words: int = MIN_WORDS, unit: str = "line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The units of each document with an id, a row for a document: its lines, and the marks of its runs of words.

    ``version``, a hash of the text, tells apart rows of one id with different texts.
    """

    def run(batches):
        from xxhash import xxh64_intdigest

        i32, i64 = np.int32, np.int64
        for batch in slices(batches, 64, (_HASHES,)):
            ids, raws = batch.column(0), batch.column(1).to_pylist()
            versions, words, lines, marks = [], [], [], []
            for raw in raws:
                text = raw.decode("utf-8", "replace")
                own = Words(text)
                found = lines_of(text, unit)
                versions.append(_signed(xxh64_intdigest(raw)))
                words.append(own.n)
                at = np.array(found, i64).reshape(-1, 3)
                hi = np.cumsum(at[:, 2])
                lo = hi - at[:, 2]
                lines.append((np.arange(len(at)), lo, hi, at[:, 0], at[:, 1], own.digests(lo, hi, 0), own.digests(lo, hi, 1)))
                marks.append(own.marks(min_words))
            names = ("place", "lo", "hi", "start", "stop", "digest", "check")
            made = {n: (i64 if n in ("digest", "check") else i32, [x[k] for x in lines]) for k, n in enumerate(names)}
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(versions, pa.int64()), pa.array(words, pa.int32()), _lists([len(x[0]) for x in lines], **made), _lists([len(x[0]) for x in marks], at=(i32, [x[0] for x in marks]), mark=(i64, [x[1] for x in marks]))],
                names=["doc_id", "version", "n_words", "lines", "marks"],
            )

    return _documents(df, id_col, text_col).mapInArrow(run, UNITS)


def _units(df: DataFrame, min_words: int, unit: str, id_col: str, text_col: str) -> DataFrame:
    """The unit table, written; rows alike in id and text are one document."""
    every = unit_table(df, min_words=min_words, unit=unit, id_col=id_col, text_col=text_col)
    repeat = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)
    return written(every.dropDuplicates(["doc_id", "version"]) if repeat else every, "units")


def _later(units: DataFrame) -> DataFrame:
    """The lines that stand earlier, with ``first``: the rank (doc_id, version, place) of the earliest."""
    lines = units.select("doc_id", "version", F.inline("lines"))
    rank = F.struct("doc_id", "version", "place")
    # Written, so that the join deals both of its sides anew and the rows of a very common line can be split among tasks.
    groups = written(lines.groupBy("digest", "check").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).where("n > 1").select("digest", "check", "first"), "line-groups")
    return lines.join(groups, ["digest", "check"]).where(rank != F.col("first"))


def repeated_lines(df: DataFrame, *, unit: str = "line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version, place, start, end, n_words, first_doc_id, first_place of every line (or paragraph) that stands earlier.

    Lines of any length: each later occurrence has a row.  Ranks, offsets and rows without an id as in ``repeated_spans``.
    """
    found = _later(_units(df, MIN_WORDS, unit, id_col, text_col))
    return found.select("doc_id", "version", "place", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("end"), (F.col("hi") - F.col("lo")).cast("bigint").alias("n_words"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.place").alias("first_place"))


def _chains(later: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, version, lo, hi, start, stop, first_doc_id) of chains of repeated lines, in words and in characters."""
    diagonal = ["doc_id", "version", "first_doc_id", "first_version", "shift"]
    placed = later.select("doc_id", "version", "place", "lo", "hi", "start", "stop", F.col("first.doc_id").alias("first_doc_id"), F.col("first.version").alias("first_version"), (F.col("place") - F.col("first.place")).alias("shift"))
    island = F.col("place") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("place"))
    joined = placed.withColumn("island", island).groupBy(*diagonal, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return joined.where(F.col("hi") - F.col("lo") >= min_words).select("doc_id", "version", "lo", "hi", "start", "stop", "first_doc_id")


def _planned(docs: DataFrame, plans: DataFrame) -> DataFrame:
    """The documents whose id's bit is set in a map of the plans' ids: all with a plan, and few others while plans are few."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(PLAN_BITS)) + 1
    bits = plans.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    placed = docs.withColumn("bucket", F.bitmap_bucket_number(bit)).withColumn("at", F.bitmap_bit_position(bit))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = placed.join(F.broadcast(bits), "bucket").where(F.expr("shiftleft(1, cast(at % 8 as int))").bitwiseAND(byte) != 0)
    return met.select(*docs.columns)


def _runs(docs: DataFrame, plans: DataFrame, min_words: int) -> DataFrame:
    """A row for each run of ``min_words`` words around a mark of its document's plan, but for those inside a chain."""
    few = plans.agg(F.count(F.lit(1)), F.max(F.size("near") + F.size("taken"))).first()
    small = few[0] <= BROADCAST_PLANS and (few[1] or 0) <= PLAN_MARKS
    joined = (docs.join(F.broadcast(plans), "doc_id") if small else _planned(docs, plans).join(plans, "doc_id")).select("doc_id", "text", "version", "near", "taken")
    back = min_words - (min_words + 1) // 2

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in slices(batches, 32, (_HASHES,)):
            parts = []
            for row in batch.to_pylist():
                if _signed(xxh64_intdigest(row["text"])) != row["version"]:
                    continue
                text = row["text"].decode("utf-8", "replace")
                own = Words(text)
                asked = np.zeros(own.n - min_words + 1, bool)
                for at in row["near"]:
                    asked[max(0, at - back) : at + 1] = True
                for t in row["taken"]:
                    asked[t["lo"] : max(t["lo"], t["hi"] - min_words + 1)] = False
                lo = np.flatnonzero(asked)
                edges = np.array([m.span() for m in re.finditer(r"\S+", text)], np.int32).reshape(-1, 2)
                parts.append((own.digests(lo, lo + min_words, 0), own.digests(lo, lo + min_words, 1), np.full(len(lo), row["doc_id"]), np.full(len(lo), row["version"]), lo, edges[lo, 0], edges[lo + min_words - 1, 1]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]), pa.int64()).cast(kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RUN.split(", ")])

    return joined.mapInArrow(run, RUN)


def _set_in(df: DataFrame, units: DataFrame, chains: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, version, lo, hi, start, stop, first_doc_id) of the runs of ``min_words`` words that stand earlier and are in no chain.

    ``units`` is removed when the plans are made.
    """
    taken = chains.groupBy("doc_id", "version").agg(F.collect_list(F.struct("lo", "hi")).alias("taken"))
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    known = units.select("doc_id", "version", "n_words", "marks").join(taken, ["doc_id", "version"], "left").withColumn("taken", F.coalesce("taken", none))
    half = (min_words + 1) // 2

    def outside(m):
        # All runs that hold the mark are in a chain: none of them is the earliest, and none is asked about.
        low, high = F.greatest(m["at"] - (min_words - half), F.lit(0)), F.least(m["at"] + min_words, F.col("n_words"))
        return ~F.exists("taken", lambda t: (t["lo"] <= low) & (t["hi"] >= high))

    marks = written(known.select("doc_id", "version", "taken", F.filter("marks", outside).alias("marks")).where(F.size("marks") > 0), "marks")
    flat = marks.select("doc_id", "version", F.inline("marks"))
    common = written(flat.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark"), "common-marks")
    near = flat.join(common, "mark").groupBy("doc_id", "version").agg(F.collect_list("at").alias("near"))
    plans = written(near.join(marks.select("doc_id", "version", "taken"), ["doc_id", "version"]), "run-plans")
    # All that is left to do reads the plans, the chains and the documents.
    for table in (units, marks, common):
        forget(table)
    # Rows alike in id and text give the same runs under the same rank, which changes nothing.
    runs = written(_runs(_documents(df, id_col, text_col), plans, min_words), "runs")
    rank = F.struct("doc_id", "version", "at")
    firsts = written(runs.groupBy("key", "check").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first <> last").select("key", "check", "first"), "run-groups")
    # A run doesn't go for one that it overlaps, of which a part would go with it.
    apart = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("version") != F.col("first.version")) | (F.col("at") >= F.col("first.at") + min_words)
    return runs.join(firsts, ["key", "check"]).where(apart).select("doc_id", "version", F.col("at").alias("lo"), (F.col("at") + min_words).alias("hi"), "start", "stop", F.col("first.doc_id").alias("first_doc_id"))


def repeated_spans(df: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version, start, end, n_words, first_doc_id of every passage that stands earlier in the corpus.

    A passage is made of runs of ``min_words`` words each of which stands earlier, as they are but for letter case and
    white space: in a row of lower rank, or further ahead in the same text without overlapping.  Runs that touch or
    overlap are one passage.  Offsets are code points, ends exclusive; ``first_doc_id`` is the lowest document that has one
    of the runs (or lines) first.  Rows are ranked by id, then by version (a hash of the text, for rows that share an id);
    rows alike in id and text are one document.  Rows without an id and null or empty texts have no passages.
    """
    units = _units(df, min_words, "line", id_col, text_col)
    chains = written(_chains(_later(units), min_words), "line-chains")
    every = chains.unionByName(_set_in(df, units, chains, min_words, id_col, text_col))
    order = Window.partitionBy("doc_id", "version").orderBy("lo", "hi", "first_doc_id")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = every.withColumn("fresh", F.when(F.col("lo") <= reach, 0).otherwise(1))
    islands = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = islands.groupBy("doc_id", "version", "island").agg(F.min("start").cast("bigint").alias("start"), F.max("stop").cast("bigint").alias("end"), (F.max("hi") - F.min("lo")).cast("bigint").alias("n_words"), F.min("first_doc_id").alias("first_doc_id"))
    return spans.select(*SPAN)


def without_repeats(df: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", spans: DataFrame | None = None) -> DataFrame:
    """The input's rows and columns with repeated passages cut from the text, and ``removed``: their [start, end] in the original.

    ``spans`` (doc_id, version, start, end) are the passages to cut, such as those of ``repeated_lines``; by default those of
    ``repeated_spans``.  No row goes; a text of repeats alone is empty.  Rows without an id, and null texts, stay as they are.
    """
    spans = repeated_spans(df, min_words=min_words, id_col=id_col, text_col=text_col) if spans is None else spans
    cuts = spans.groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).agg(F.array_sort(F.collect_list(F.array("start", "end"))).alias("__cuts"))
    rows = df.withColumn("__own", _version(F.col(text_col)))
    joined = rows.join(cuts, (F.col(id_col) == F.col("__id")) & (F.col("__own") == F.col("__version")), "left")
    empty = F.array().cast("array<array<bigint>>")
    cut = F.coalesce("__cuts", empty)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("kept"))
    text = F.col(text_col)

    def step(acc, span):
        between = F.substring(text, (acc["at"] + 1).cast("int"), (span[0] - acc["at"]).cast("int"))
        return F.struct(span[1].alias("at"), F.concat(acc["kept"], between).alias("kept"))

    rest = F.aggregate(cut, start, step, lambda acc: F.concat(acc["kept"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return joined.withColumn(text_col, F.when(F.size(cut) > 0, rest).otherwise(text)).withColumn("removed", cut).drop("__id", "__version", "__cuts", "__own")


def _version(text):
    from pyspark.sql.types import LongType

    @F.pandas_udf(LongType())
    def hashed(texts):
        import pandas as pd
        from xxhash import xxh64_intdigest

        return pd.Series([None if t is None else _signed(xxh64_intdigest(t)) for t in texts], dtype="Int64")

    return hashed(text.cast("binary"))
