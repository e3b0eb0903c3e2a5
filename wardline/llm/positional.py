"""Distributed positional inverted index, and benchmark decontamination on it.

The index is cut by documents into segments of bounded text; a segment is one row that holds its documents'
ids and word counts, its terms, and for every term the delta-coded positions of all its occurrences.  A
query runs on each segment by itself, so neither a common term nor a common passage meets in one task and
nothing is shuffled.  A phrase is found by subtracting each term's offset from its positions and intersecting
these lists from the rarest term on; a window of terms within a span is found from the rarest term's positions.

Positions of a segment's documents follow one another with a gap between documents, so no match crosses two.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, release, scratch, slices, trim, worker_memo, written

#: A segment is closed at the document that brings it to so many bytes of text.
SEGMENT_BYTES = 8 << 20
#: Query texts are searched in blocks of so many bytes.
BLOCK_BYTES = 2 << 20
#: Positions between two documents; a window may be as wide.
GAP = 64
#: Segments that a task holds open while it goes through several blocks of query texts.
GROUP = 4
SEGMENT = "doc_ids array<bigint>, n_words array<int>, terms binary, counts binary, postings binary"

# Fixed: words are runs of [0-9A-Za-z] and of all bytes of characters beyond ASCII; A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(_FOLD).split() if text else []


def _pack(values: np.ndarray) -> bytes:
    """Non-negative integers below 2**35, seven bits a byte, low bits first; all but the last byte of each have the high bit."""
    if not len(values) or int(values.max()) < 128:
        return values.astype(np.uint8).tobytes()
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        if not (more := values >= 1 << 7 * k).any():
            break
        size += more
    starts = np.cumsum(size)
    out = np.empty(int(starts[-1]), np.uint8)
    starts -= size
    out[starts] = (values & 127) | ((size > 1) << 7)
    for k in range(1, int(size.max())):
        has = np.flatnonzero(size > k)
        out[starts[has] + k] = (values[has] >> 7 * k & 127) | ((size[has] > k + 1) << 7)
    return out.tobytes()


def _unpack(data: bytes | np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    if last.all():
        return raw.astype(np.int64)
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    out = np.zeros(len(ends), np.int64)
    for k in range(int(size.max())):
        has = size > k
        out[has] |= (raw[starts[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def segment(doc_ids: list, texts: list[list[bytes]]) -> dict:
    """The segment row of documents given as word lists."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = [len(t) for t in texts]
    total = sum(sizes)
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int32, total)
    positions = np.arange(total, dtype=np.int64) + np.repeat(np.arange(len(sizes), dtype=np.int64) * GAP, sizes)
    counts = np.bincount(ids, minlength=len(known))
    # A sort of (term, position) pairs in one integer each is faster than a stable argsort of the terms.
    ordered = np.sort(ids.astype(np.int64) << 34 | positions) & (1 << 34) - 1
    delta = np.diff(ordered, prepend=0)
    first = np.cumsum(counts) - counts
    delta[first] = ordered[first]
    return {"doc_ids": doc_ids, "n_words": sizes, "terms": b" ".join(known), "counts": _pack(counts), "postings": _pack(delta)}


class Segment:
    """A segment row opened for queries.  Posting lists are decoded when a query first asks for their term."""

    def __init__(self, row: dict):
        self.doc_ids, self.n_words = row["doc_ids"], np.asarray(row["n_words"], np.int64)
        self.starts = np.cumsum(self.n_words + GAP) - (self.n_words + GAP)
        self._row = {t: i for i, t in enumerate(row["terms"].split())}
        self.counts = _unpack(row["counts"])
        self._ends = np.cumsum(self.counts)
        self._raw = np.frombuffer(row["postings"], np.uint8)
        self._bytes = np.concatenate([[0], np.flatnonzero(self._raw < 128) + 1])
        self._lists: dict[bytes, np.ndarray] = {}

    def count(self, term: bytes) -> int:
        return int(self.counts[i]) if (i := self._row.get(term)) is not None else 0

    def positions(self, term: bytes) -> np.ndarray:
        if (own := self._lists.get(term)) is None:
            if (i := self._row.get(term)) is None:
                own = np.zeros(0, np.int64)
            else:
                last = int(self._ends[i])
                own = np.cumsum(_unpack(self._raw[self._bytes[last - int(self.counts[i])] : self._bytes[last]]))
            self._lists[term] = own
        return own

    def phrase(self, terms: list[bytes]) -> np.ndarray:
        """Positions at which the terms stand one after the other."""
        ranked = sorted(range(len(terms)), key=lambda k: self.count(terms[k]))
        if not terms or not self.count(terms[ranked[0]]):
            return np.zeros(0, np.int64)
        found = self.positions(terms[ranked[0]]) - ranked[0]
        for k in ranked[1:]:
            found = _both(found, self.positions(terms[k]), k)
            if not len(found):
                break
        return found

    def near(self, terms: list[bytes], span: int) -> list[tuple[int, int]]:
        """(start, end) of the smallest windows of ``span`` positions at most that hold every term, one for each occurrence of the rarest term."""
        if span > GAP:
            raise ValueError(f"a span of {span}; the index separates documents by {GAP}")
        own = sorted(set(terms), key=self.count)
        if not own or not self.count(own[0]):
            return []
        lists = [self.positions(t) for t in own]
        out = []
        for at in lists[0].tolist():
            cuts = [other[np.searchsorted(other, at - span + 1) : np.searchsorted(other, at + span)] for other in lists[1:]]
            if any(not len(c) for c in cuts):
                continue
            best = None
            for low in sorted({at, *(x for c in cuts for x in c.tolist() if x <= at)}, reverse=True):
                nexts = [c[np.searchsorted(c, low) :] for c in cuts]
                if any(not len(c) for c in nexts):
                    continue
                high = max([at, *(int(c[0]) for c in nexts)])
                if high - low < span and (best is None or high - low < best[1] - best[0]):
                    best = (low, high)
            if best:
                out.append((best[0], best[1] + 1))
        return out

    def documents(self, positions: np.ndarray) -> np.ndarray:
        """The document (its place in the segment) of each position."""
        return np.searchsorted(self.starts, positions, "right") - 1


def _both(found: np.ndarray, other: np.ndarray, offset: int) -> np.ndarray:
    """Those of ``found`` that plus ``offset`` are in ``other``; both ascend."""
    at = np.searchsorted(other, found + offset)
    at[at == len(other)] = 0
    return found[other[at] == found + offset]


def build(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of whole texts: one row per segment, every document in one of them.

    A null text has no words; null ids, repeated rows and empty texts are indexed as they are; other columns
    are not read.  Memory is bounded by SEGMENT_BYTES and the longest document.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()), ("postings", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        ids, texts, held = [], [], 0
        for batch in slices(batches, 64):
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(words(raw))
                held += len(raw or b"")
                if held >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist([segment(ids, texts)], schema=schema)
                    ids, texts, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([segment(ids, texts)], schema=schema)

    return docs.mapInArrow(run, SEGMENT)


def windows_of(items: Iterable[tuple], size: int) -> tuple[list[list[bytes]], list[list[int]]]:
    """(distinct windows, the items of each) of (item, text) rows: ``size`` consecutive words, or all of a shorter item."""
    place: dict[tuple, int] = {}
    owners: list[list] = []
    for item, text in items:
        own = words(text)
        for k in range(max(1, len(own) - size + 1) if own else 0):
            w = tuple(own[k : k + size])
            if w not in place:
                place[w] = len(owners)
                owners.append([])
            if not owners[place[w]] or owners[place[w]][-1] != item:
                owners[place[w]].append(item)
    return [list(w) for w in place], owners


def blocks_of(items: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The query texts in blocks of bounded bytes, brought to the driver one at a time."""
    held, block = 0, []
    for row in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        block.append((row[0], bytes(row[1]) if row[1] is not None else None))
        held += len(row[1] or b"")
        if held >= limit:
            yield block
            held, block = 0, []
    yield block


def search_phrases(index: DataFrame, phrases: list[str], *, span: int | None = None) -> DataFrame:
    """doc_id, phrase (its place in ``phrases``), start, end (word offsets) of every match of every phrase.

    Without ``span`` a match has the phrase's words one after the other; with it, all of them in any order
    within that many words: one smallest window for each occurrence of the phrase's rarest word.
    """
    queries = [words(p.encode()) for p in phrases]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own, out = Segment(row), []
                for q, terms in enumerate(queries):
                    found = own.near(terms, span) if span else [(p, p + len(terms)) for p in own.phrase(terms).tolist()]
                    for start, end in found:
                        d = int(own.documents(np.array([start]))[0])
                        base = int(own.starts[d])
                        if end - base <= own.n_words[d]:
                            out.append((own.doc_ids[d], q, start - base, end - base))
                c = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64())], names=["doc_id", "phrase", "start", "end"])

    return index.mapInArrow(run, "doc_id bigint, phrase int, start bigint, end bigint")


class Windows:
    """The distinct windows of the query texts as rows of term numbers, and the items of each."""

    def __init__(self, windows: list[list[bytes]], owners: list[list[str]]):
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        width = max(map(len, windows), default=1)
        self.rows = np.full((len(windows), width), -1, np.int32)
        for row, terms in zip(self.rows, windows):
            row[: len(terms)] = [known[t] for t in terms]
        self.sizes, self.owners, self.terms = [len(w) for w in windows], owners, list(known)


def _matches(own: Segment, queries: Windows, ranges: dict[int, list], items: dict[int, set]) -> None:
    """Add the windows' occurrences in a segment to ``ranges`` ({document: [(start, end)] in words}) and ``items`` ({document: items})."""
    # The last entry is for the places of a short window that hold no term.
    counts = np.array([*map(own.count, queries.terms), np.iinfo(np.int64).max])[queries.rows]
    alive = np.flatnonzero(counts.min(1, initial=np.iinfo(np.int64).max) > 0)
    order = np.argsort(counts[alive], axis=1, kind="stable").tolist()
    for q, ranked, terms in zip(alive.tolist(), order, queries.rows[alive].tolist()):
        size = queries.sizes[q]
        found = own.positions(queries.terms[terms[ranked[0]]]) - ranked[0]
        for k in ranked[1:size]:
            found = _both(found, own.positions(queries.terms[terms[k]]), k)
            if not len(found):
                break
        for d, p in zip(own.documents(found).tolist(), found.tolist()):
            at = p - int(own.starts[d])
            ranges.setdefault(d, []).append((at, at + size))
            items.setdefault(d, set()).update(queries.owners[q])


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def contamination(index: DataFrame, items: DataFrame, *, window: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per indexed document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_ranges.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item with words.  A document's
    word inside an occurrence of a window is hit; ``hit_ranges`` has the hit ranges of words.  Items are cut into
    blocks of BLOCK_BYTES, each a file in the shared folder; a task searches its segments for one block after the
    other, so every document gets its one row from one task whatever the items' size, without a shuffle or a
    broadcast.  A null item id counts as the string "null".
    """
    if window > GAP:
        raise ValueError(f"a window of {window} words; the index separates documents by {GAP}")
    blocks = list(_block_files(index.sparkSession, items, window, item_col, text_col))

    def run(batches):
        release(_LAST)
        rows = (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(batch.num_rows))
        while group := list(islice(rows, 1 if len(blocks) == 1 else GROUP)):
            opened = [(Segment(row), {}, {}) for row in group]
            del group
            for path in blocks:
                queries = _block(path)
                for own, ranges, found in opened:
                    _matches(own, queries, ranges, found)
            while opened:
                yield _verdicts(*opened.pop(0))
        trim()

    return index.mapInArrow(run, VERDICT)


VERDICT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, hit_ranges array<int>"


def _verdicts(own: Segment, ranges: dict[int, list], items: dict[int, set]) -> pa.RecordBatch:
    nothing = hashlib.sha256(b"").hexdigest()
    hit = {d: _merged(r) for d, r in ranges.items()}
    digests = {d: hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for d, i in items.items()}
    every = range(len(own.doc_ids))
    counts = [sum(b - a for a, b in hit.get(d, ())) for d in every]
    columns = {"doc_id": pa.array(own.doc_ids, pa.int64()), "n_words": pa.array(own.n_words, pa.int64()), "n_hit": pa.array(counts, pa.int64()), "n_items": pa.array([len(items.get(d, ())) for d in every], pa.int64())}
    columns |= {"items_sha256": pa.array([digests.get(d, nothing) for d in every], pa.string()), "contaminated": pa.array([n > 0 for n in counts], pa.bool_()), "hit_ranges": pa.array([[x for r in hit.get(d, ()) for x in r] for d in every], pa.list_(pa.int32()))}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _block_files(spark, items: DataFrame, window: int, item_col: str, text_col: str) -> Iterator[str]:
    """The windows of the items, a file for each block, named in order; the driver holds one block at a time."""
    folder = scratch(spark, "query-blocks")
    for n, block in enumerate(blocks_of(items, item_col, text_col)):
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{n:06d}") as out:
            out.write(pickle.dumps(Windows(*windows_of([("null" if i is None else i, t) for i, t in block], window))))
        yield f"{folder}/{n:06d}"


#: The block that this worker read last.
_LAST: dict[str, Windows] = worker_memo({})


def _block(path: str) -> Windows:
    if path not in _LAST:
        fs, at = filesystem(path)
        with fs.open_input_stream(at) as f:
            data = f.read()
        _LAST.clear()
        _LAST[path] = pickle.loads(data)
    return _LAST[path]


def decontaminate(df: DataFrame, items: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Build the index of the documents in the shared folder, and search it for every window of the items."""
    return contamination(written(build(df, id_col=id_col, text_col=text_col), "positional-index"), items, window=window, item_col=item_col, text_col="text")
