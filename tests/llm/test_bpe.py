import codecs
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from wardline.llm import bpe_fst, queries

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe_fst.parse_ranks(bpe_fst.read_ranks(VOCABULARY))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_documents_as_the_library_has_them(docs, rows, library):
    out = bpe_fst.encode_documents(docs, VOCABULARY, P.PATTERN, keep=("lang",), decoded=True)
    got = sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["decoded"]) for r in out.collect())
    want = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((repr(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    assert got == sorted(want)


def test_random_texts(ranks, library):
    codec = bpe_fst.Codec(ranks, P.PATTERN)
    r = random.Random(2)
    for k in range(3000):
        if k % 3 == 0:
            text = "".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0x2FFF), r.randint(0x10000, 0x1F9FF)])) for _ in range(r.randint(0, 20)))
        elif k % 3 == 1:
            text = library.decode([r.randint(0, 50255) for _ in range(r.randint(1, 4))])
        else:
            text = "".join(r.choice("aab bc\n\n\t  é中\x1c\x85\xa0.,!!'st12😀ABC \x00\x01") for _ in range(r.randint(0, 14)))
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text


def test_memo_bounds_only_cost_time(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe_fst, "STATE_MEMO", 50)
    monkeypatch.setattr(bpe_fst, "UNIT_MEMO", 3)
    codec = bpe_fst.Codec(ranks, P.PATTERN)
    text = " ".join(f"word{i % 40} thing" for i in range(400))
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_lookahead_is_bounded_and_pieces_equal_their_merges(ranks):
    fst = bpe_fst.Transducer(ranks)
    r = random.Random(4)
    for _ in range(300):
        piece = bytes(r.choice(b"aeinorst") for _ in range(r.randint(1, 25)))
        if piece not in ranks:
            assert fst.piece(piece) == fst.merges(piece)
    longest = max(map(len, ranks))
    assert all(sum(len(fst.bytes_of[t]) for t in owed) <= 2 * longest for s in fst._states.values() for owed, _, _ in s.hyps)


def test_new_words_need_few_new_states(ranks):
    """Readings that can no longer end are dropped, and previous tokens that leave the same open share states."""
    codec = bpe_fst.Codec(ranks, P.PATTERN)
    r = random.Random(11)
    parts = "an ber che die ent er ge he in ion keit la lich nd ou que re sch th tion ung ver wh y".split()
    words = ["".join(r.choice(parts) for _ in range(r.randint(2, 5))) for _ in range(12_000)]
    codec.encode(" ".join(words[:10_000]))
    first = len(codec.fst._states)
    codec.encode(" ".join(words[10_000:]))
    more = len(codec.fst._states) - first
    assert first < 4_000
    assert more < 400


def made_up_ranks(r, alphabet, ordered):
    """A vocabulary of random merges; if not ``ordered``, tokens may rank before their parts."""
    parts, made = [bytes([b]) for b in alphabet], []
    while len(made) < 40:
        if len(token := r.choice(parts) + r.choice(parts)) <= 12 and token not in parts:
            parts.append(token)
            made.append(token)
    if not ordered:
        r.shuffle(made)
    return {token: 3 * i for i, token in enumerate([bytes([b]) for b in range(256)] + made)}


@pytest.mark.parametrize("used_bytes", [bpe_fst.USED_BYTES, 2])
@pytest.mark.parametrize("ordered", [True, False])
def test_made_up_vocabularies(ordered, used_bytes, monkeypatch):
    monkeypatch.setattr(bpe_fst, "USED_BYTES", used_bytes)
    r, kinds = random.Random(12), set()
    for _ in range(40):
        alphabet = r.choice([b"ab", b"abc", b"abcd\xc3"])
        fst = bpe_fst.Transducer(own := made_up_ranks(r, alphabet, ordered))
        kinds.add(fst._ordered)
        for _ in range(60):
            if (piece := bytes(r.choice(alphabet) for _ in range(r.randint(1, 30)))) not in own:
                assert fst.piece(piece) == fst.merges(piece), (piece, own)
    assert ordered in kinds


def test_utf8_stream():
    data = "aé中😀�".encode() + b"\xff\xe2\x82z\xed\xa0\x80\xf4\x90\xc0\xe0\x9f\xc2"
    for a in range(len(data) + 1):
        for b in range(a, len(data) + 1):
            s = bpe_fst.Utf8Stream()
            got = s.feed(data[:a]) + s.feed(data[a:b]) + s.feed(data[b:]) + s.finish()
            assert got == codecs.decode(data, "utf-8", "replace")


def test_utf8_automaton_over_all_short_strings():
    import itertools

    some = [0x00, 0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xEC, 0xED, 0xEE, 0xEF, 0xF0, 0xF1, 0xF3, 0xF4, 0xF5, 0xFF]
    for n in range(1, 5):
        for data in itertools.product(some, repeat=n) if n < 4 else itertools.product(some[12:24], some, (0x41, 0x80, 0xBF, 0xC2), (0x80, 0x9F, 0xF0)):
            s = bpe_fst.Utf8Stream()
            assert "".join([s.feed(bytes([b])) for b in data]) + s.finish() == bytes(data).decode("utf-8", "replace")
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    strict = bpe_fst.Utf8Stream("strict")
    assert strict.feed(every.encode()) + strict.finish() == every
    with pytest.raises(ValueError):
        strict.feed(b"\xed\xa0")


@pytest.mark.parametrize("pattern", [r"\s+|\S+", r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+", r".|\n"])
def test_other_patterns_split_whole_texts(ranks, pattern):
    library, codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe_fst.Codec(ranks, pattern)
    r = random.Random(7)
    for _ in range(400):
        text = "".join(r.choice(["Hello", " ", "  ", "\n", "\n\n", ".", "!?", "é", "12345", "\r\n", "'s", "word"]) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text), repr(text)


def test_no_vocabulary():
    with pytest.raises(ValueError):
        bpe_fst.Transducer({b"a": 0})


def test_empty_table(spark, docs, sf):
    assert bpe_fst.encode_documents(docs.limit(0), VOCABULARY, P.PATTERN).collect() == []
    out = queries.op7_bpe(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 200


def test_a_worker_drops_the_memos_of_other_operators(monkeypatch):
    from wardline.llm import bpe_fst, common, repeats

    monkeypatch.setitem(bpe_fst._CODECS, "kept", object())
    monkeypatch.setitem(repeats._HASHES, "word", 1)
    assert list(common.slices(iter([]), memos=(bpe_fst._CODECS,))) == []
    assert "kept" in bpe_fst._CODECS and not repeats._HASHES
    assert list(common.slices(iter([]))) == [] and not bpe_fst._CODECS
