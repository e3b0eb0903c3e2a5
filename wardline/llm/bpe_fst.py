"""Byte-level BPE compiled into a lazily determinised finite-state transducer.

A tokenisation of a byte string is the one that the ranked merges give exactly if every token is the
merges' own encoding of its bytes and every adjacent pair of tokens is *compatible*: the merges encode
the pair's bytes as that pair.  So the merges compile into a non-deterministic transducer whose states
are (previous token, node in the trie of token bytes); reading a byte follows the trie, and a node that
ends a token compatible with the previous one also leads to the trie's root with that token as output.
Each prefix has exactly one valid tokenisation, so at each moment one hypothesis stands at a token's end
and few others are inside a longer token.

The transducer is determinised while it runs: a deterministic state is the set of live hypotheses with
the tokens that each still owes, and what all of them owe in common is emitted on the transition.  A
token therefore leaves as soon as the bytes seen rule out every other reading, at most the longest
token's length later.  Of the previous token a state holds only what the merges could still join to the
bytes that follow, and readings that no compatible token can end are dropped, so few states serve all texts
(under ranks that put a token before its parts, a state holds the previous token itself).  States and
transitions are memoised, as are the ids of recurring text units, both within stated bounds that only cost
recomputation.

Decoding joins token bytes and feeds them to an incremental UTF-8 state machine, which accepts chunks
cut anywhere, inside a character too.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, slices, worker_memo
from .units import FRONT_SPACE, Memo, literal, unit_keys

#: Memoised text units of one worker.
UNIT_MEMO = 250_000
#: Memoised deterministic states of one worker, and compatible pairs of tokens (of ranks that put a token before its parts).  When full, further states are made for
#: the moment only; after as many of those as RENEW times the bound, all start anew.
STATE_MEMO, PAIR_MEMO, RENEW = 80_000, 150_000, 50
#: Conflicts with parts up to so many bytes are looked up for all tokens below a node; with longer ones, when a token ends.
USED_BYTES = 32
#: A rank file beyond this is not a vocabulary to ship to every worker.
MAX_RANK_FILE = 64 << 20


class _State(dict):
    """Its transitions: by byte, the next state and the tokens emitted."""

    __slots__ = ("final", "hyps")

    def __init__(self, hyps, final):
        self.hyps, self.final = hyps, final


#: What a previous token leaves open when it conflicts with nothing that can follow.
_FREE = ((), ())


class Transducer:
    """Encodes one piece (a match of the split pattern) as the ranked merges do."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the single bytes {missing[:8]}")
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._top = max(ranks.values()) + 1
        self._pairs: dict[tuple[int, int], bool] = {}
        #: The last merge of each token that the merges make of its own bytes; (-1, -1) for single bytes.
        self._split: dict[int, tuple[int, int]] = {}
        for token, i in ranks.items():
            parts = self.merges(token, 2) if len(token) > 1 else [-1, -1]
            if len(parts) == 2:
                self._split[i] = parts[0], parts[1]
        #: Whether every token's parts rank before it, as in any vocabulary that was learned merge by merge.
        self._ordered = all(max(parts) < i for i, parts in self._split.items())
        self._build_trie()
        self._reset()

    def _build_trie(self) -> None:
        """The trie of token bytes.

        Of each node the least and greatest token below and the range of those in byte order, of each left part the
        least and greatest token, of each token and length of its first parts (itself, its left part, that one's left part
        and so on) the merge that uses the part up.
        """
        following: dict[int, int] = {}
        parents, ends = array("i", [-1]), array("i", [-1])
        order = sorted(self._split, key=self.bytes_of.__getitem__)
        begin, stop = array("i", [0]), array("i", [len(order)])
        used = np.full((USED_BYTES + 1, len(order)), -1, np.int32)
        for at, i in enumerate(order):
            node = 0
            for b in self.bytes_of[i]:
                if (nxt := following.get(node << 8 | b)) is None:
                    nxt = following[node << 8 | b] = len(ends)
                    parents.append(node)
                    ends.append(-1)
                    begin.append(at)
                    stop.append(at)
                node = nxt
                stop[node] = at + 1
            ends[node] = i
            begin[node] += 1
            over, part = i, self._split[i][0]
            while part >= 0:
                if (n := len(self.bytes_of[part])) <= USED_BYTES:
                    used[n, at] = over
                over, part = part, self._split[part][0]
        low, high = array("i", [self._top]) * len(ends), array("i", [-1]) * len(ends)
        for node in range(len(ends) - 1, 0, -1):
            up, own = parents[node], ends[node]
            low[up] = min(low[up], low[node], own if own >= 0 else self._top)
            high[up] = max(high[up], high[node], own)
        least, most = array("i", [self._top]) * self._top, array("i", [-1]) * self._top
        for i, (left, _) in self._split.items():
            if left >= 0:
                least[left], most[left] = min(least[left], i), max(most[left], i)
        self._following, self._ends, self._low, self._high, self._least, self._most = following, ends, low, high, least, most
        self._begin, self._stop, self._used = begin, stop, used

    def _reset(self) -> None:
        self._states: dict[tuple, _State] = {}
        self._passing = 0
        self.start = self._states.setdefault(hyps := (((), _FREE if self._ordered else -1, 0),), _State(hyps, ()))

    def merges(self, piece: bytes, until: int = 1) -> list[int]:
        """The definition: join the adjacent pair of lowest rank, leftmost first, until none is left (or ``until`` parts are)."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        while len(parts) > until:
            least, at = min(((r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None), default=(None, 0))
            if least is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _left_open(self, token: int):
        """What ``token`` before a token's start leaves open: (bound, node) pairs and (part, rank) conflicts.

        A merge over the boundary joins a part at the token's end (the token, its right part, that one's right part and
        so on) to a part at the next token's start, if it ranks before the merges that use these parts up.  A pair is a
        part's trie node, moved on by the bytes since, and the rank that ends it; a conflict is a part of the
        next token that a merge of that rank would join.  Tokens that leave the same open share their states.
        """
        if not self._ordered:
            return token
        pairs, bound, part = [], self._top, token
        while part >= 0:
            if self._least[part] < bound:
                node = 0
                for b in self.bytes_of[part]:
                    node = self._following[node << 8 | b]
                pairs.append((self._top if self._most[part] < bound else bound, node))
            bound, part = part, self._split[part][1]
        return (tuple(pairs), ()) if pairs else _FREE

    def _narrowed(self, still, byte: int, child: int):
        """``still`` after another byte, which leads to ``child``."""
        if not self._ordered or still is _FREE:
            return still
        pairs, conflicts, right = [], dict(still[1]), self._ends[child]
        for bound, node in still[0]:
            if (node := self._following.get(node << 8 | byte)) is None:
                continue
            over = self._ends[node]
            if right >= 0 and 0 <= over < bound and self._split[over][1] == right:
                conflicts[right] = min(over, conflicts.get(right, over))
            if self._low[node] < bound:
                pairs.append((self._top if self._high[node] < bound else bound, node))
        return (tuple(pairs), tuple(conflicts.items())) if pairs or conflicts else _FREE

    def _onward(self, still, child: int):
        """``still`` for readings that go on below ``child``, without conflicts that no token there has; None if every token there has one."""
        if not self._ordered or not still[1]:
            return still
        conflicts, free = [], True
        for part, rank in still[1]:
            if (n := len(self.bytes_of[part])) > USED_BYTES:
                conflicts.append((part, rank))
                continue
            hit = self._used[n, self._begin[child] : self._stop[child]] >= rank
            if hit.any():
                conflicts.append((part, rank))
                free = free & ~hit
                if not free.any():
                    return None
        return (still[0], tuple(conflicts)) if still[0] or conflicts else _FREE

    def _compatible(self, still, right: int) -> bool:
        """Whether the merges leave the boundary between what ``still`` stands for and the token ``right``."""
        if self._ordered:
            for joined, rank in still[1]:
                bound, part = self._top, right
                while part >= 0:
                    if part == joined and rank <= bound:
                        return False
                    bound, part = part, self._split[part][0]
            return True
        if still < 0:
            return True
        if (known := self._pairs.get((still, right))) is None:
            known = self.merges(self.bytes_of[still] + self.bytes_of[right]) == [still, right]
            if len(self._pairs) < PAIR_MEMO:
                self._pairs[still, right] = known
        return known

    def _advance(self, state: _State, byte: int) -> tuple[_State, tuple]:
        hyps, final = [], None
        for owed, still, node in state.hyps:
            if (child := self._following.get(node << 8 | byte)) is None:
                continue
            still = self._narrowed(still, byte, child)
            if self._low[child] < self._top and (onward := self._onward(still, child)) is not None:
                hyps.append((owed, onward, child))
            token = self._ends[child]
            if token >= 0 and final is None and self._compatible(still, token):
                final = (*owed, token)
                hyps.append((final, self._left_open(token), 0))
        if final is None:
            raise ValueError("the ranks are no byte-pair vocabulary: a prefix has no valid tokenisation")
        common = final
        for owed, _, _ in hyps:
            n = 0
            for a, b in zip(common, owed):
                if a != b:
                    break
                n += 1
            common = common[:n]
        k = len(common)
        key = tuple([(owed[k:], still, node) for owed, still, node in hyps])
        if (to := self._states.get(key)) is None:
            to = _State(key, final[k:])
            if len(self._states) >= STATE_MEMO:
                self._passing += 1
                if self._passing > RENEW * STATE_MEMO:
                    self._pairs.clear()
                    self._reset()
                return to, common
            self._states[key] = to
        step = to, common
        if self._states.get(state.hyps) is state:
            state[byte] = step
        return step

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself a token is that token, as tiktoken has it."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        out: list[int] = []
        state = self.start
        for byte in piece:
            state, emitted = state.get(byte) or self._advance(state, byte)
            if emitted:
                out += emitted
        out += state.final
        return out


def _utf8_table() -> list[list[int]]:
    """The automaton's next state by state and byte, from the definition of well-formed UTF-8.

    State 0 is between characters; 1 to 3 wait for as many continuation bytes; 4 to 7 are those after the lead
    bytes E0, ED, F0 and F4, whose first continuation byte has bounds of its own; -1 is where nothing leads.
    """
    table = [[-1] * 256 for _ in range(8)]
    for state, low, high, to in ((0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE0, 0xEF, 2), (0, 0xF0, 0xF4, 3), (0, 0xE0, 0xE0, 4), (0, 0xED, 0xED, 5), (0, 0xF0, 0xF0, 6), (0, 0xF4, 0xF4, 7), (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        table[state][low : high + 1] = [to] * (high + 1 - low)
    return table


class Utf8Stream:
    """Incremental UTF-8 as a table-driven automaton: feed() takes bytes cut anywhere and returns the text complete so far.

    What can't go on is one U+FFFD for each longest start of a character, or an error with errors="strict".  Runs of
    ASCII stay in the state between characters, so they are taken as a whole.
    """

    _NEXT = _utf8_table()
    _ASCII = re.compile(rb"[\x00-\x7f]+").match
    #: Bits of a lead byte that belong to the character, by the state that it leads to.
    _BITS = (0x7F, 0x1F, 0x0F, 0x07, 0x0F, 0x0F, 0x07, 0x07)

    def __init__(self, errors: str = "replace"):
        self._strict, self._state, self._code = errors == "strict", 0, 0

    def _bad(self) -> str:
        if self._strict:
            raise ValueError("bytes that are not well-formed UTF-8")
        return "\ufffd"

    def feed(self, data: bytes) -> str:
        out, at, end = [], 0, len(data)
        state, code, table, bits, ascii_run = self._state, self._code, self._NEXT, self._BITS, self._ASCII
        while at < end:
            if not state and (run := ascii_run(data, at)):
                out.append(run[0].decode("ascii"))
                at = run.end()
                continue
            byte = data[at]
            to = table[state][byte]
            if to < 0:
                out.append(self._bad())
                # A byte that breaks a character off may begin the next one.
                at += not state
                state = 0
                continue
            code = code << 6 | byte & 0x3F if state else byte & bits[to]
            state = to
            at += 1
            if not state:
                out.append(chr(code))
        self._state, self._code = state, code
        return "".join(out)

    def finish(self) -> str:
        broken, self._state = self._state, 0
        return self._bad() if broken else ""


class Codec:
    """Whole texts to ids and back, over a Transducer and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.fst = Transducer(ranks)
        self._split = regex.compile(pattern).findall
        self._by_units = pattern in FRONT_SPACE
        self._memo = Memo(UNIT_MEMO)
        self._table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self._table[i] = token

    def _piece(self, piece: str) -> bytes:
        return array("I", self.fst.piece(piece.encode("utf-8", "surrogatepass"))).tobytes()

    def _unit(self, text: str) -> bytes:
        return b"".join([self._piece(piece) for piece in self._split(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; each distinct unit of a text runs through the transducer once.

        Under a pattern that isn't known to split units as it splits their text, the text's pieces are its units.
        """
        memo = self._memo
        keys = unit_keys(text) if self._by_units else [" " + piece for piece in self._split(text)]
        out = list(map(memo.get, keys))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            if (ids := memo.get(keys[i])) is None:
                memo.keep(keys[i], ids := self._unit(literal(keys[i])) if self._by_units else self._piece(keys[i][1:]))
            out[i] = ids
        return b"".join(out)

    def decode_bytes(self, ids: bytes, chunk: int = 1 << 16) -> Iterator[bytes]:
        """The bytes of ids (little-endian unsigned 32-bit), in chunks of tokens."""
        table = self._table
        array = np.frombuffer(ids, "<u4")
        for at in range(0, len(array), chunk):
            yield b"".join([table[i] for i in array[at : at + chunk].tolist()])

    def decode(self, ids: bytes) -> str:
        stream = Utf8Stream()
        return "".join([stream.feed(part) for part in self.decode_bytes(ids)]) + stream.finish()


def read_ranks(path: str) -> bytes:
    """The rank file at ``path`` (a URI or local path), read on the driver; refused beyond MAX_RANK_FILE."""
    fs, at = filesystem(path)
    if fs.get_file_info(at).size > MAX_RANK_FILE:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE} bytes")
    with fs.open_input_stream(at) as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


_CODECS: dict[tuple, Codec] = worker_memo({})


def _codec(data: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(parse_ranks(data), pattern)
    return _CODECS[key]


def encode_documents(df: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = (), decoded: bool = False) -> DataFrame:
    """Encode every whole text, and decode the ids again.

    Returns ``id_col``, the columns of ``keep``, ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens``,
    ``ids_sha256`` and ``decoded_sha256`` (of the UTF-8 of the text that the ids decode to), and with ``decoded`` that
    text.  One row for each input row; a null or empty text has no ids; a null id stays; other columns
    of the input, whatever their names, are not read.  Special-token strings in a text are ordinary text.
    """
    data = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    keep = [c for c in keep if c not in (id_col, text_col)]
    base = df.select(F.col(id_col), *[F.col(c) for c in keep], F.col(text_col).cast("binary").alias("_text"))
    kind = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kind[c]}" for c in [id_col, *keep]) + ", ids binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", decoded string" if decoded else "")

    def run(batches):
        codec = _codec(data.value, pattern)
        for batch in slices(batches, memos=(_CODECS,)):
            ids, digests, back, texts = [], [], [], []
            for raw in batch.column(batch.num_columns - 1).to_pylist():
                own = codec.encode((raw or b"").decode("utf-8", "replace"))
                sha, stream, parts = hashlib.sha256(), Utf8Stream(), []
                for part in codec.decode_bytes(own):
                    text = stream.feed(part)
                    sha.update(text.encode())
                    if decoded:
                        parts.append(text)
                rest = stream.finish()
                sha.update(rest.encode())
                ids.append(own)
                digests.append(hashlib.sha256(own).hexdigest())
                back.append(sha.hexdigest())
                texts.append("".join(parts) + rest)
            columns = [*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string())] if decoded else []), names=[*batch.schema.names[:-1], "ids", "n_tokens", "ids_sha256", "decoded_sha256", *(["decoded"] if decoded else [])])

    return base.mapInArrow(run, schema)
