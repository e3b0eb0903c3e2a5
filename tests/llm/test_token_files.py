import io
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from wardline.llm import huffman, queries, token_files
from wardline.llm.common import scratch

VOCABULARY = P.path("byte_bpe_50k.json")


def expected(rows, ordinary=False):
    library = Tokenizer.from_file(VOCABULARY)
    if ordinary:
        library.encode_special_tokens = True
    out, start = [], 0
    encoded = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]
    for i, ids in sorted(encoded, key=lambda x: (x[0] is not None, x[0] or 0)):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(docs, rows):
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.round_trip(docs, VOCABULARY).collect()), key=lambda r: r[1])
    want = expected(rows)
    # Rows of one id are in an order of their own.
    assert [g[0] for g in got] == [w[0] for w in want] and sorted((repr(g[0]), *g[2:]) for g in got) == sorted((repr(w[0]), *w[2:]) for w in want)
    ends = [g[1] + g[2] for g in got]
    assert [g[1] for g in got] == [0, *ends[:-1]]


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y", " <|endoftext|>\n\n <|endoftext|>  z", "<|endoftext|><|endoftext|>", "<|endoftext |>", "no <|endof text|>"]


@pytest.mark.parametrize("ordinary", [False, True])
def test_special_tokens_are_as_the_library_has_them(spark, ordinary):
    rows = [(i, f"before {t} after") for i, t in enumerate(SPECIAL)] + [(i + 100, t) for i, t in enumerate(SPECIAL)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    manifest = token_files.write_token_files(df, VOCABULARY, scratch(spark, "t"), ordinary=ordinary)
    got = sorted(tuple(r)[:4] for r in token_files.read_token_files(spark, manifest).collect())
    assert got == expected(rows, ordinary) and expected(rows) != expected(rows, True)
    assert token_files.Tokenizer(token_files.read_definition(VOCABULARY)).encode(["a <|endoftext|> b"])[0] == np.array([64, 220, 50256, 275], "<u4").tobytes()


def test_definitions_that_split_otherwise_get_whole_texts():
    import json

    from tokenizers.pre_tokenizers import Split, Sequence, ByteLevel

    texts = ["a.\n\n b  c", "Word, word!\n", "", "  x <|endoftext|>y"]
    for change in ("prefix", "normalizer", "split"):
        library = Tokenizer.from_file(VOCABULARY)
        if change == "prefix":
            library.pre_tokenizer = ByteLevel(add_prefix_space=True)
        elif change == "normalizer":
            spec = json.loads(library.to_str()) | {"normalizer": {"type": "Lowercase"}}
            library = Tokenizer.from_str(json.dumps(spec))
        else:
            library.pre_tokenizer = Sequence([Split(".\n", "merged_with_previous"), ByteLevel(add_prefix_space=False, use_regex=False)])
        own = token_files.Tokenizer(library.to_str())
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_an_id_of_very_many_rows_is_dealt_to_several_files(spark):
    rows = [(None, f"null {i}") for i in range(300)] + [(7, f"seven {i}") for i in range(300)] + [(i, f"own {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    manifest = token_files.write_token_files(df, VOCABULARY, scratch(spark, "t"))
    assert manifest.agg({"n_docs": "max"}).first()[0] < 250
    got = [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in sorted(token_files.read_token_files(spark, manifest).collect(), key=lambda r: r["start"])]
    assert [g[0] for g in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert sorted(map(repr, got)) == sorted(repr((w[0], *w[2:])) for w in expected(rows))


def test_the_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op4_token_files(spark, sf).collect())
    assert got == expected(rows)


def test_small_files_and_empty_table(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 500)
    manifest = token_files.write_token_files(docs, VOCABULARY, scratch(spark, "t"))
    assert token_files.read_token_files(spark, manifest).count() == len(rows)
    assert token_files.round_trip(docs.limit(0), VOCABULARY).collect() == []


@pytest.mark.parametrize(("n", "symbols", "docs_"), [(0, 10, 0), (1, 10, 1), (5, 1, 3), (300_000, 50_000, 100), (5000, 2, 7)])
def test_format(n, symbols, docs_):
    r = np.random.default_rng(n)
    ids = ((r.zipf(1.3, n) - 1) % symbols).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=symbols))
    assert lengths.max(initial=0) <= huffman.MAX_BITS and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    parts = np.split(ids, np.sort(r.integers(0, n + 1, docs_ - 1))) if docs_ else []
    out = io.BytesIO()
    writer = huffman.Writer(out, lengths, block=64)
    for i, p in enumerate(parts):
        writer.add(None if i == 1 else i, p)
    assert writer.close() == len(out.getvalue())
    reader = huffman.Reader(out, len(out.getvalue()))
    assert [np.concatenate([np.zeros(0, np.uint32), *p]).tolist() for _, p in reader.documents()] == [p.tolist() for p in parts]
    assert reader.known.tolist() == [int(i != 1) for i in range(len(parts))]
    if n > 1000:
        k = len(reader.offsets) // 2
        assert reader.blocks(k, k + 1).tolist() == ids[k * 64 : (k + 1) * 64].tolist()


def test_lengths_are_optimal():
    import heapq

    r = np.random.default_rng(1)
    counts = r.integers(1, 1000, 200)
    heap = [(int(c), i, 0) for i, c in enumerate(counts)]
    total, n = 0, 1000
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], n, 0))
        n += 1
    assert int((huffman.code_lengths(counts, 30) * counts).sum()) == total
    limited = huffman.code_lengths(2 ** np.arange(30), 6)
    assert limited.max() == 6 and sum(2.0 ** -int(x) for x in limited) == 1


def test_damage_is_seen():
    out = io.BytesIO()
    writer = huffman.Writer(out, huffman.code_lengths(np.array([3, 4, 5])))
    writer.add(1, np.array([0, 1, 2], np.uint32))
    size = writer.close()
    data = bytearray(out.getvalue())
    for at in (0, size - 1, size - 90):
        bad = bytearray(data)
        bad[at] ^= 255
        with pytest.raises(Exception):  # noqa: B017
            huffman.Reader(io.BytesIO(bytes(bad)), size)
    with pytest.raises(ValueError, match="without a code"):
        w = huffman.Writer(io.BytesIO(), huffman.code_lengths(np.array([3, 4, 0])))
        w.add(1, np.array([2], np.uint32))
        w.close()


def test_words_at_the_front_of_a_line_pass_the_splitter(monkeypatch):
    library = Tokenizer.from_file(VOCABULARY)
    texts = ["Ébloui a\nWord one,\nOther. end\nword a\nWord", "  two  spaces\n\n Lines\nÇa", "".join(f"w{'abcdefghij'[k % 10] * (k // 10)} " for k in range(1500)) + "end"]
    tok = token_files.Tokenizer(token_files.read_definition(VOCABULARY))
    whole, own = [], token_files.Tokenizer._ids
    monkeypatch.setattr(tok, "_ids", lambda used, given: (whole.extend(given) if used is tok._library else None, own(used, given))[1])
    for joined in (3, 512):
        monkeypatch.setattr(token_files, "JOINED_WORDS", joined, raising=False)
        tok._memo.clear()
        found = tok.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert not [w for w in whole if w.strip() in ("Word", "Other.", "word", "Ça")]


def test_words_with_any_marks_pass_the_splitter_and_reach_the_model_once(monkeypatch):
    library = Tokenizer.from_file(VOCABULARY)
    words = ["thingthwh", "Éboulis", "schgeöst", "ONSHAN"]
    marks = ["", ",", ".", "!!", "$$$", "###", ",###", ".***", "%%%", "&&&", ")", "...", "_", "`~^", "<=>", "[\\]", "{|}", "@/-+*"]
    texts = [" ".join(w + m for w in words for m in marks), "\n".join(w + m for w in words for m in marks)]
    tok = token_files.Tokenizer(token_files.read_definition(VOCABULARY))
    whole, own = [], token_files.Tokenizer._ids
    monkeypatch.setattr(tok, "_ids", lambda used, given: (whole.extend(given), own(used, given))[1])
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(whole) == len(set(whole)) and not [t for t in whole if any(c.isalpha() for c in t)]
    # Split otherwise: runs of spaces, an apostrophe takes letters along, digits and letters that versions of Unicode may not share.
    texts = ["  ".join(w + m for w in words for m in marks), "it's we'll. x'", "a,'s b.'t ''re", "don't, 'd'", "a1, 1a. ²x x² ẞ! ɐ. ʰ,", "word\u00a0, word\u3000.\tword\x1f,", "a\u0301, 😀!! ,a ..b \"c\""]
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_full_memo_gives_the_same_ids_and_goes_with_its_tokenizer(monkeypatch):
    import weakref

    library = Tokenizer.from_file(VOCABULARY)
    texts = [f"{a}{b} {b}{a}, {a}.\n{b}!! {a}{a}" for a in ("one", "Two", "drei", "vier") for b in ("fünf", "six", "sept")]
    for limit in (0, 1, 5):
        monkeypatch.setattr(token_files, "UNIT_MEMO", limit)
        monkeypatch.setattr(token_files, "MARKS_MEMO", limit, raising=False)
        tok = token_files.Tokenizer(token_files.read_definition(VOCABULARY))
        assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert len(tok._memo) <= limit
    gone = weakref.ref(tok)
    del tok
    assert gone() is None


def test_ids_are_counted_many_documents_at_a_time(monkeypatch):
    r, calls, real = np.random.default_rng(3), [], np.bincount
    documents = [r.integers(0, 50_000, n).astype(np.uint32) for n in r.integers(0, 300, 400)]
    want = real(np.concatenate(documents), minlength=50_257)
    monkeypatch.setattr(np, "bincount", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    assert (token_files.count_ids(iter(documents), 50_257) == want).all() and len(calls) == 1
    monkeypatch.setattr(token_files, "COUNTED_IDS", 1000)
    assert (token_files.count_ids(iter(documents), 50_257) == want).all() and 1 < len(calls) < 80
    assert token_files.count_ids([], 5).tolist() == [0] * 5 == token_files.count_ids([np.zeros(0, np.uint32)], 5).tolist()


def test_runs_of_white_space_are_found():
    from wardline.llm import units

    space = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = ["", "a", "a b", "a\nb", "é b\nc", "漢 b"] + [f"{x}{a}{b}{y}" for a in space for b in ("", *space) for x, y in (("a", "b"), ("é", "ü"), ("漢", "字 b\nc"))]
    assert [units._spaced(t) for t in texts] == [units._RUNS.search(t) is not None for t in texts]


def test_a_worker_keeps_its_tokenizer_from_task_to_task(spark, docs):
    def mark(_):
        import os

        from wardline.llm import token_files as here

        for tok in here._TOKENIZERS.values():
            yield os.getpid(), getattr(tok, "seen", False)
            tok.seen = True

    def marked():
        return spark.sparkContext.parallelize(range(16), 16).mapPartitions(mark).collect()

    def write():
        assert token_files.write_token_files(docs.repartition(16), VOCABULARY, scratch(spark, "t")).count()

    write()
    before = {pid for pid, _ in marked()}
    write()
    # A worker's later marks are of its first.
    after = dict(reversed(marked()))
    assert before & set(after) and all(after[pid] for pid in before & set(after))
