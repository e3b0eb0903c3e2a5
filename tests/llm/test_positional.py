import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from wardline.llm import positional, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add("null" if item is None else str(item))
    out = []
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((repr(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def got(df):
    return sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect())


@pytest.fixture(scope="module")
def items(spark, rows):
    texts = {i: t for i, t in rows}
    long = texts[13].split()
    made = [(1, " ".join(long[50:80])), (2, "word"), (3, None), (4, ""), (5, " ".join(long[60:90]).upper()), (10, texts[6]), (None, "spaces test"), (7, "no such passage in any of the documents at all here"), (8, "x x x x x x x x x x x x"), (9, "x x x"), (2, "word"), (11, "... !!!")]
    return spark.createDataFrame([(i, t, "c") for i, t in made], "item_id bigint, text string, doc_id string")


@pytest.mark.parametrize("segment", [1, 3000, 1 << 24])
def test_against_brute_force(docs, rows, items, monkeypatch, segment):
    monkeypatch.setattr(positional, "SEGMENT_BYTES", segment)
    assert got(positional.decontaminate(docs, items)) == plain(rows, [(r["item_id"], r["text"]) for r in items.collect()])


def test_items_in_blocks_give_the_same(docs, rows, items, monkeypatch):
    monkeypatch.setattr(positional, "BLOCK_BYTES", 100)
    assert got(positional.decontaminate(docs, items)) == plain(rows, [(r["item_id"], r["text"]) for r in items.collect()])


@pytest.mark.parametrize("segment", [1, 1 << 24])
def test_repeated_rows_and_null_ids_stay_with_items_in_blocks(spark, monkeypatch, segment):
    monkeypatch.setattr(positional, "BLOCK_BYTES", 30)
    monkeypatch.setattr(positional, "SEGMENT_BYTES", segment)
    r = random.Random(5)
    say = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    one, other = say(30), say(30)
    docs = [(1, one), (1, one), (1, one), (None, one), (None, other), (None, "a b c"), (None, "d e f"), (2, None), (2, ""), (None, None)]
    items = [(k, say(3)) for k in range(20)] + [(99, one[10:40]), (None, other)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    assert got(positional.decontaminate(df, spark.createDataFrame(items, "item_id bigint, text string"))) == plain(docs, items)


def test_empty_tables(docs, rows, items):
    assert positional.decontaminate(docs.limit(0), items).collect() == []
    assert got(positional.decontaminate(docs, items.limit(0))) == plain(rows, [])


def test_the_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = queries.op8_decontamination(spark, sf)
    want = con.execute(queries.SQL["op8_decontamination"])
    assert out.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, out.collect())) == sorted(want.fetchall())


def test_packing():
    r = np.random.default_rng(0)
    for values in (np.zeros(0, np.int64), np.array([0, 127, 128, 16383, 16384, (1 << 35) - 1, 1 << 28]), r.integers(0, 1 << 30, 5000), r.integers(0, 127, 100)):
        assert positional._unpack(positional._pack(values)).tolist() == values.tolist()


def test_phrases_and_proximity(spark):
    r = random.Random(3)
    texts = [[r.choice("abcdef") for _ in range(r.randint(0, 60))] for _ in range(60)]
    index = positional.build(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    phrases = ["a b", "c", "a a b", "f e d c", "zz", ""]
    exact = {(x["doc_id"], x["phrase"], x["start"], x["end"]) for x in positional.search_phrases(index, phrases).collect()}
    want = {(i, q, k, k + len(p.split())) for i, t in enumerate(texts) for q, p in enumerate(phrases) if p for k in range(len(t) - len(p.split()) + 1) if t[k : k + len(p.split())] == p.split()}
    assert exact == want
    near = {(x["doc_id"], x["phrase"]) for x in positional.search_phrases(index, phrases, span=4).collect()}
    close = {(i, q) for i, t in enumerate(texts) for q, p in enumerate(phrases) if p for k in range(len(t)) if set(p.split()) <= set(t[k : k + 4])}
    assert near == close
    with pytest.raises(ValueError, match="separates"):
        positional.Segment(positional.segment([1], [[b"a"]])).near([b"a"], 1000)
