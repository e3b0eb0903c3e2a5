"""Token-id files: canonical, length-limited Huffman codes from global counts.

A file is self-contained::

    magic | u32 longest code, u32 symbols, u32 size | zlib(code lengths, one byte a symbol)
    bit stream, most significant bit first
    zlib(bit offset of every block, u64) | zlib(document ids i64, flags u8, token counts u64)
    trailer (fixed size) | magic

Code lengths come from the package-merge algorithm over the counts of the whole corpus, codes are canonical,
so the lengths alone define them.  Every ``block`` tokens the checkpoint table keeps the stream's bit offset:
blocks decode independently, and the reader runs many of them in step through one lookup table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"WLHUF\x00\x01\n"
_HEAD = struct.Struct("<III")
_TAIL = struct.Struct("<QQQQQQQI")
#: Longest code wanted; more only where the vocabulary needs it.  The decoding table has two to this power entries.
MAX_BITS = 18
BLOCK = 1024
#: Tokens packed at a time.
CHUNK = 1 << 18


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 for symbols that don't occur."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    max_bits = max(max_bits, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order]
    leaf_masks, packages = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        leaf_masks.append(rank < len(weights))
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    bits = np.zeros(len(order), np.int64)
    take = 2 * len(order) - 2
    for mask in reversed(leaf_masks):
        leaves = int(mask[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = bits
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes by symbol, symbols in code order) of code lengths."""
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
    codes = np.zeros(len(lengths), np.uint64)
    if len(symbols):
        own = lengths[symbols].astype(np.int64)
        longest = int(own[-1])
        step = np.left_shift(np.int64(1), longest - own)
        start = np.cumsum(step) - step
        codes[symbols] = (start >> (longest - own)).astype(np.uint64)
    return codes, symbols


class Writer:
    """Streams documents into a file object; holds one chunk of tokens and the tables of its own file."""

    def __init__(self, out, lengths: np.ndarray, block: int = BLOCK):
        self.out, self.block = out, block
        self.lengths = lengths.astype(np.uint64)
        self.codes, _ = canonical(lengths)
        packed = zlib.compress(lengths.astype(np.uint8).tobytes(), 6)
        head = MAGIC + _HEAD.pack(int(lengths.max(initial=0)), len(lengths), len(packed)) + packed
        out.write(head)
        self.start, self.bits, self.carry = len(head), 0, np.uint64(0)
        self.pending: list[np.ndarray] = []
        self.held = self.tokens = self.packed = 0
        self.offsets: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        self.tokens += len(ids)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= CHUNK:
            self._pack()

    def _pack(self) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        self.pending, self.held = [], 0
        for at in range(0, len(ids), CHUNK):
            self._put(ids[at : at + CHUNK])

    def _put(self, ids: np.ndarray) -> None:
        size = self.lengths[ids]
        if not size.all():
            raise ValueError("an id without a code: the counts don't cover this corpus")
        ends = np.cumsum(size) + np.uint64(self.bits & 31)
        at = ends - size
        first = -self.packed % self.block
        self.offsets.append((at[first :: self.block] + np.uint64(self.bits - (self.bits & 31))).astype("<u8"))
        word = at >> np.uint64(5)
        window = self.codes[ids] << (np.uint64(64) - (at & np.uint64(31)) - size)
        groups = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        total = int(ends[-1])
        words = np.zeros((total >> 5) + 2, np.uint64)
        here = word[groups].astype(np.int64)
        words[here] = np.bitwise_or.reduceat(window >> np.uint64(32), groups)
        words[here + 1] |= np.bitwise_or.reduceat(window & np.uint64(0xFFFFFFFF), groups)
        words[0] |= self.carry
        self.out.write(words[: total >> 5].astype(">u4").tobytes())
        self.carry = words[total >> 5]
        self.bits += total - (self.bits & 31)
        self.packed += len(ids)

    def close(self) -> int:
        """Writes what is left and the tables; returns the file's size."""
        self._pack()
        tail_bits = ((self.bits & 31) + 7) // 8
        self.out.write(int(self.carry).to_bytes(4, "big")[:tail_bits])
        stream = self.bits // 32 * 4 + tail_bits
        offsets = zlib.compress(np.concatenate([*self.offsets, np.zeros(0, "<u8")]).astype("<u8").tobytes(), 6)
        known = np.array([x is not None for x in self.ids], np.uint8)
        docs = zlib.compress(np.array([x or 0 for x in self.ids], "<i8").tobytes() + known.tobytes() + np.array(self.sizes, "<u8").tobytes(), 6)
        tail = _TAIL.pack(self.start, self.bits, self.tokens, len(self.ids), self.block, len(offsets), len(docs), zlib.crc32(offsets + docs))
        self.out.write(offsets + docs + tail + MAGIC)
        return self.start + stream + len(offsets) + len(docs) + len(tail) + len(MAGIC)


class Reader:
    """Reads a file through a random-access file object."""

    def __init__(self, file, size: int):
        self.file = file
        if size < len(MAGIC) * 2 + _TAIL.size:
            raise ValueError("no token file: too short")
        tail = self._at(size - len(MAGIC) - _TAIL.size, _TAIL.size + len(MAGIC))
        if self._at(0, len(MAGIC)) != MAGIC or tail[_TAIL.size :] != MAGIC:
            raise ValueError("no token file: wrong magic")
        self.start, self.bits, self.tokens, self.n_docs, self.block, n_offsets, n_docs, crc = _TAIL.unpack(tail[: _TAIL.size])
        tables = self._at(size - len(MAGIC) - _TAIL.size - n_offsets - n_docs, n_offsets + n_docs)
        if zlib.crc32(tables) != crc:
            raise ValueError("damaged token file: tables")
        self.offsets = np.frombuffer(zlib.decompress(tables[:n_offsets]), "<u8")
        docs = zlib.decompress(tables[n_offsets:])
        k = self.n_docs
        self.ids = np.frombuffer(docs[: 8 * k], "<i8")
        self.known = np.frombuffer(docs[8 * k : 9 * k], np.uint8)
        self.sizes = np.frombuffer(docs[9 * k :], "<u8").astype(np.int64)
        longest, symbols, packed = _HEAD.unpack(self._at(len(MAGIC), _HEAD.size))
        lengths = np.frombuffer(zlib.decompress(self._at(len(MAGIC) + _HEAD.size, packed)), np.uint8)
        if len(lengths) != symbols:
            raise ValueError("damaged token file: code lengths")
        self.longest = max(longest, 1)
        _, order = canonical(lengths)
        spread = np.left_shift(np.int64(1), self.longest - lengths[order].astype(np.int64))
        entry = order.astype(np.uint64) | lengths[order].astype(np.uint64) << np.uint64(32)
        self.table = np.zeros(1 << self.longest, np.uint64)
        self.table[: int(spread.sum())] = np.repeat(entry, spread)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks ``first`` to ``last`` (exclusive), all decoded in step."""
        count = min(self.tokens, last * self.block) - first * self.block
        begin = int(self.offsets[first])
        end = int(self.offsets[last]) if last < len(self.offsets) else self.bits
        raw = self._at(self.start + begin // 32 * 4, (end + 31) // 32 * 4 - begin // 32 * 4)
        pad = 8 + 4 * (self.block * self.longest // 32 + 2)
        words = np.frombuffer(raw[: (end + 7) // 8 - begin // 32 * 4] + bytes(pad + (-len(raw[: (end + 7) // 8 - begin // 32 * 4]) % 4)), ">u4").astype(np.uint64)
        pairs = words[:-1] << np.uint64(32) | words[1:]
        at = self.offsets[first:last] - np.uint64(begin // 32 * 32)
        out = np.empty((self.block, last - first), np.uint32)
        shift, mask, low, five = np.uint64(64 - self.longest), np.uint64((1 << self.longest) - 1), np.uint64(31), np.uint64(5)
        ids32, top = np.uint64(0xFFFFFFFF), np.uint64(32)
        limit = np.uint64(len(pairs) * 32 - 1)
        for step in range(min(self.block, count)):
            entry = self.table[(pairs[at >> five] >> (shift - (at & low))) & mask]
            out[step] = entry & ids32
            at = np.minimum(at + (entry >> top), limit)
        return out.T.reshape(-1)[:count]

    def stream(self, group: int = 1024) -> Iterator[np.ndarray]:
        """All ids in order, ``group`` blocks at a time."""
        for first in range(0, len(self.offsets), group):
            yield self.blocks(first, min(first + group, len(self.offsets)))

    def documents(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(position, parts of its ids) of every document, in order.  A document's parts may span decoding groups."""
        left: np.ndarray = np.zeros(0, np.uint32)
        source = self.stream()
        for k, need in enumerate(self.sizes.tolist()):
            parts = []
            while need:
                if not len(left):
                    left = next(source)
                part, left = left[:need], left[need:]
                parts.append(part)
                need -= len(part)
            yield k, parts
