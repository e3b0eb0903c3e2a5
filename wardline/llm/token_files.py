"""Documents to Huffman-coded token files in ascending document order, and back.

One pass tokenises and deals documents to ranges of the id; the dealt ids stay in the shuffle, where two jobs
read them: the first counts every id over the whole corpus, the second sorts each range and writes its file
with the one code that those counts give.  (RDDs, because two jobs must share one shuffle: each range is read
twice, but tokenised and moved once.)  Files written by lost or repeated task attempts have names of their
own and are in no manifest.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import weakref
import zlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, release, scratch, trim, worker_memo, written
from .huffman import Reader, Writer, code_lengths
from .units import Memo, literal, unit_keys

#: Memoised text units of one worker.
UNIT_MEMO = 1_000_000
#: Memoised runs of marks of one worker.
MARKS_MEMO = 10_000
#: Ids counted at a time.
COUNTED_IDS = 1 << 20
#: A tokenizer file beyond this is not a vocabulary to ship to every worker.
MAX_TOKENIZER_FILE = 64 << 20
#: A file is closed at the document that brings it to so many tokens.
FILE_TOKENS = 32 << 20

MANIFEST = "part int, seq int, path string, bytes bigint, n_docs bigint, n_tokens bigint"


# Letters on which every version of Unicode agrees.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
# The key of a unit that is a word after a space and no more.
_BARE = re.compile(f"[{_LETTERS}]+")
# The key of any unit that splits plainly: a line's first word or a word after a space, then marks.  Its pieces under
# the byte-level split are the newline, the word with its space, and the marks together.  An apostrophe is no such mark:
# the split may take letters with it.
_PLAIN = re.compile(f"(\\n|  ?| \\n|)([{_LETTERS}]+)([!-&(-/:-@\\[-`{{-~]*)")
# Whether a space is before the word, and the piece before it, by how the key begins (see ``literal``).
_FRONTS = {"": (True, ""), "  ": (True, ""), " ": (False, ""), "\n": (False, "\n"), " \n": (False, "\n")}


class _Units(Memo):
    """Ids by unit key, which its tokenizer gives when they aren't there; it doesn't keep that from being freed."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__(UNIT_MEMO)
        self.tokenizer = weakref.ref(tokenizer)

    def __missing__(self, key: str) -> bytes:
        ids = self.tokenizer()._unit_ids(key)
        if len(self) < self.limit:
            self[key] = ids
        else:
            self.keep(key, ids)
        return ids


class Tokenizer:
    """The tokenizers library over text units, each distinct unit encoded once.

    Only the usual byte-level split, without normalisation or truncation, treats a unit as it does the unit's text;
    under any other definition, and where a text has one of the tokens that the definition finds before it splits,
    the library gets the whole text.  Under that split a plain unit's pieces are known, so its word goes to the library
    model as one piece, past its splitter, and is shared with the units that differ by marks; all other units go to it whole.
    With ``ordinary`` the strings of special tokens are ordinary text; else they are those tokens, as the library has it.
    """

    def __init__(self, definition: str, ordinary: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library
        from tokenizers.pre_tokenizers import ByteLevel

        self._library = Library.from_str(definition)
        self._library.encode_special_tokens = ordinary
        self.width = self._library.get_vocab_size()
        self._memo, self._marks = _Units(self), Memo(MARKS_MEMO)
        spec = json.loads(definition)
        split = spec.get("pre_tokenizer") or {}
        odd = any(spec.get(k) for k in ("normalizer", "truncation", "padding")) or (spec.get("model") or {}).get("dropout")
        self._units = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not odd
        own = [t["content"] for t in spec.get("added_tokens") or () if not (ordinary and t.get("special"))]
        self._added = re.compile("|".join(map(re.escape, own))).search if own else None
        if self._units:
            letters = [chr(c) for c in range(0x250) if _BARE.fullmatch(chr(c))]
            as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            # The bytes of a word's characters as the model has them.
            self._bytes = {ord(c): as_bytes(c)[0][0] for c in (" ", *letters)}
            self._tokens = self._library.model.tokenize

    @staticmethod
    def _ids(library, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _word_ids(self, word: str) -> bytes:
        """Ids of a word of letters with its space, if it has one."""
        return array("I", [t.id for t in self._tokens(word.translate(self._bytes))]).tobytes()

    def _mark_ids(self, mark: str) -> bytes:
        """Ids of a newline, or of marks that are one piece."""
        ids = self._marks.get(mark)
        if ids is None:
            ids = self._ids(self._library, [mark])[0]
            self._marks.keep(mark, ids)
        return ids

    def _unit_ids(self, key: str) -> bytes:
        """Ids of a unit that the memo doesn't have."""
        if _BARE.fullmatch(key):
            return self._word_ids(" " + key)
        plain = _PLAIN.fullmatch(key)
        if not plain:
            return self._ids(self._library, [literal(key)])[0]
        front, word, after = plain.groups()
        spaced, before = _FRONTS[front]
        # The key of the word alone, unless that is the unit.
        own = word if spaced else " " + word
        ids = self._word_ids(literal(own)) if own == key else self._memo[own]
        if before:
            ids = self._mark_ids(before) + ids
        return ids + self._mark_ids(after) if after else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        whole = [i for i, t in enumerate(texts) if not self._units or self._added is not None and self._added(t)]
        if whole:
            apart = dict(zip(whole, self._ids(self._library, [texts[i] for i in whole])))
            rest = iter(self._by_units([t for i, t in enumerate(texts) if i not in apart]))
            return [apart[i] if i in apart else next(rest) for i in range(len(texts))]
        return self._by_units(texts)

    def _by_units(self, texts: list[str]) -> list[bytes]:
        ids_of = self._memo.__getitem__
        return [b"".join(map(ids_of, unit_keys(t))) for t in texts]


_TOKENIZERS: dict[tuple[bytes, bool], Tokenizer] = worker_memo({})


def _tokenizer(definition: str, ordinary: bool = False) -> Tokenizer:
    key = hashlib.sha256(definition.encode()).digest(), ordinary
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = Tokenizer(definition, ordinary)
    return _TOKENIZERS[key]


def _task_tokenizer(definition: str, ordinary: bool) -> Tokenizer:
    """The worker's tokenizer, when a task begins.

    A function of the module, since a task's own functions get copies of the globals that they name, so that the
    worker's memo would be none that the task uses, and go.
    """
    release(_TOKENIZERS)
    return _tokenizer(definition, ordinary)


def read_definition(path: str) -> str:
    """The tokenizer file at ``path`` (a URI or local path), read on the driver; refused beyond MAX_TOKENIZER_FILE."""
    fs, at = filesystem(path)
    if fs.get_file_info(at).size > MAX_TOKENIZER_FILE:
        raise ValueError(f"{path} is larger than {MAX_TOKENIZER_FILE} bytes")
    with fs.open_input_stream(at) as f:
        return f.read().decode("utf-8")


def _batched(rows, size: int, volume: int = 1 << 21):
    batch, held = [], 0
    for row in rows:
        batch.append(row)
        held += len(row[1] or "")
        if len(batch) >= size or held >= volume:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def count_ids(documents: Iterable[np.ndarray], width: int) -> np.ndarray:
    """How often each id below ``width`` occurs; documents are counted many at a time, as each count is as long as the vocabulary."""
    total, held, size = np.zeros(width, np.int64), [], 0
    for ids in documents:
        held.append(ids)
        size += len(ids)
        if size >= COUNTED_IDS:
            total += np.bincount(np.concatenate(held), minlength=width)
            held, size = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=width)
    return total


def write_token_files(df: DataFrame, tokenizer: str, folder: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ordinary: bool = False) -> DataFrame:
    """Tokenise whole texts, append ``end_id`` to each and write the ids under ``folder`` in ascending ``id_col`` order.

    Returns the manifest (part, seq, path, bytes, n_docs, n_tokens), ordered by (part, seq): rows of equal
    ids keep together in an order of their own, a null id comes first, a null or empty text gives the end
    id alone, and an empty table gives an empty manifest.  Columns other than the two are not read.  A string of a
    special token is that token, as in the library; with ``ordinary`` it is ordinary text.  An id, or no id, that very
    many rows have takes as many ranges as its share of the rows.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    source = docs.rdd
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * source.getNumPartitions())
    total, without = docs.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull())).first()
    first = -(-without * parts // max(1, total))
    cuts = docs.approxQuantile("id", [i / parts for i in range(1, parts)], 0.25 / parts)
    # A cut that repeats is an id of several ranges' rows.
    bounds = np.sort(np.asarray(cuts or [], np.float64)).astype(np.int64)
    definition = spark.sparkContext.broadcast(read_definition(tokenizer))

    def tokenised(rows):
        import zstandard

        tok, pack = _task_tokenizer(definition.value, ordinary), zstandard.ZstdCompressor(level=1).compress
        n = 0
        for batch in _batched(rows, 256):
            for row, ids in zip(batch, tok.encode([t or "" for _, t in batch])):
                narrow = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                n += 1
                yield (row[0], n), pack(narrow.astype("<u2" if tok.width <= 1 << 16 else "<u4").tobytes())
        trim()

    wide = spark.sparkContext.broadcast(_tokenizer(definition.value, ordinary).width)

    def ids_of(data: bytes) -> np.ndarray:
        import zstandard

        return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u2" if wide.value <= 1 << 16 else "<u4").astype(np.uint32)

    def deal(key) -> int:
        """The range of a row (id, place in its task): rows of an id that fills several ranges take turns in them."""
        doc_id, n = key
        if doc_id is None:
            return n % first
        low, high = (int(np.searchsorted(bounds, doc_id, side)) for side in ("left", "right"))
        return first + (high if high - low < 2 else low + n % (high - low + 1))

    dealt = source.mapPartitions(tokenised).partitionBy(first + len(bounds) + 1, deal)

    def counted(rows):
        yield count_ids((ids_of(data) for _, data in rows), wide.value)

    counts = dealt.mapPartitions(counted).treeReduce(lambda a, b: a + b, depth=3)
    lengths = spark.sparkContext.broadcast(code_lengths(counts))

    def write(part, rows):
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        rows = sorted(rows, key=lambda r: (r[0][0] is not None, r[0][0] or 0, r[1]))
        k = seq = 0
        while k < len(rows):
            name = f"{folder}/part-{part:06d}-{seq:03d}-{uuid.uuid4().hex[:8]}.ids"
            with fs.open_output_stream(filesystem(name)[1]) as out:
                writer = Writer(out, lengths.value)
                first = k
                while k < len(rows) and writer.tokens < FILE_TOKENS:
                    writer.add(rows[k][0][0], ids_of(rows[k][1]))
                    k += 1
                size = writer.close()
            yield part, seq, name, size, k - first, writer.tokens
            seq += 1

    return written(spark.createDataFrame(dealt.mapPartitionsWithIndex(write), MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Decode the files of a manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file, ordinal.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers.  Decoding holds one group of
    blocks at a time, however long the file or a document is.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", "bytes", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = filesystem(row["path"])
                with fs.open_input_file(at) as f:
                    reader = Reader(f, row["bytes"])
                    crcs = np.zeros(reader.n_docs, np.int64)
                    for k, parts in reader.documents():
                        crc = 0
                        for part in parts:
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        crcs[k] = crc
                    starts = row["base"] + np.cumsum(reader.sizes) - reader.sizes
                    n = reader.n_docs
                    yield pa.RecordBatch.from_arrays([pa.array(reader.ids, pa.int64(), mask=reader.known == 0), pa.array(starts, pa.int64()), pa.array(reader.sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array([row["path"]] * n, pa.string()), pa.array(np.arange(n), pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "ordinal"])

    count = max(1, manifest.count())
    return files.repartition(min(count, 4096)).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string, ordinal bigint")


def round_trip(df: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents' token files to the shared folder and read them back."""
    spark = df.sparkSession
    return read_token_files(spark, write_token_files(df, tokenizer, scratch(spark, "token-files")))
