import random

import numpy as np
import pytest
import xxhash

from wardline.llm import components, near_copies, queries, simhash
from wardline.llm.common import written


def plain_print(text, size=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    total = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            total[b] += h >> b & 1
    return sum(1 << b for b in range(64) if total[b] * 2 > len(shingles))


def groups(nodes, linked):
    """{node: smallest node reachable} by brute force."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_groups_against_brute_force(docs, rows):
    out = simhash.near_groups(docs).collect()
    prints = [(i, plain_print(t)) for i, t in rows]
    label = groups({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(least.get(label[p], i), i)
    want = sorted((repr(i), f"{p:016x}", repr(least.get(label[p]))) for i, p in prints)
    assert sorted((repr(r["doc_id"]), r["fingerprint"], repr(r["component_id"])) for r in out) == want
    assert simhash.near_groups(docs.limit(0)).collect() == []


def test_the_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {d["doc_id"]: plain_print(d["text"]) for d in docs}
    label = groups(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash_near_dedup(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", label[i]) for i, p in prints.items()}


def clustered(n, seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n // 10)]
    prints = set(base)
    for _ in range(n):
        x = r.choice(base[:3] + [r.choice(base)])
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    return sorted(prints)


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_finds_every_pair(budget):
    prints = np.array(clustered(600, budget), np.uint64)
    found = {(min(x, y), max(x, y)) for a, b in simhash.trie_links(prints, np.array([0, len(prints)]), budget) for x, y in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if int(prints[i] ^ prints[j]).bit_count() <= budget}
    assert found == want


@pytest.mark.parametrize("limit", [4, 40, 10_000])
def test_large_buckets_lose_no_link(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "FRONTIER", 200)
    prints = clustered(800, 9)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    linked = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df, 2, limit).collect()]
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in linked:
        assert a in root and b in root
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {p: find(p) for p in prints} == groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3), (1, None)] + [(500, 500 + k) for k in range(1, 40)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)]
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    pairs = {frozenset(e) for e in real}
    assert got == groups({x for e in real for x in e}, lambda a, b: frozenset((a, b)) in pairs)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def family(r, size, copies, edits):
    vocabulary = [f"w{k}" for k in range(2000)]
    base = [r.choice(vocabulary) for _ in range(size)]
    out = [base]
    for _ in range(copies):
        own = list(r.choice(out))
        for _ in range(r.randint(0, edits)):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        out.append(own)
    return [" ".join(x) for x in out]


@pytest.fixture(scope="module")
def crowd(spark):
    r = random.Random(6)
    line = "one line that very many of the documents share with each other"
    texts = [t for _ in range(25) for t in family(r, r.randint(6, 150), r.randint(0, 6), 3)] + family(r, 200, 60, 4)
    texts += [line + " " + t for t in family(r, 12, 1, 0) for _ in range(2)] + [f"{line} own{k} words{k} here{k}" for k in range(60)] + ["", None, " ", "a", "A\n", "b c"]
    return [(k * 3 + 1, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("small", [True, False])
def test_near_copies_against_brute_force(spark, crowd, monkeypatch, small):
    if small:
        monkeypatch.setattr(near_copies, "BUCKET_DOCS", 20)
        monkeypatch.setattr(near_copies, "BLOCK_DOCS", 15)
        monkeypatch.setattr(near_copies, "BROADCAST_BUCKETS", 0)
        monkeypatch.setattr(near_copies, "TABLE_BYTES", 0)
    sets = {i: frozenset(simhash.shingle_hashes(simhash.words((t or "").encode()), 5).tolist()) for i, t in crowd}
    want = groups(sets, lambda a, b: (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(written(spark.createDataFrame(crowd, "doc_id bigint, text string"), "crowd")).collect()}
    assert got.keys() == want.keys()
    wrong = [i for i in got if got[i] != want[i]]
    # Sampled buckets miss a pair at the threshold with a small probability; exact copies never.
    assert len(wrong) <= 0.01 * len(got)
    assert len(set(want.values())) < len(want) - 50


def test_near_dedup_hard_rows(docs, rows):
    out = near_copies.near_dedup(docs)
    ids = sorted((r["doc_id"] for r in out.collect()), key=repr)
    assert set(out.columns) == set(docs.columns)
    assert None in ids and ids.count(18) == 2
    assert {1, 4, 6, -5, 13} <= set(ids) and not {2, 3, 5, 8, 9} & set(ids)
    assert near_copies.near_dedup(docs.limit(0)).collect() == []


def test_shared_elements_are_counted_either_way(monkeypatch):
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, r.integers(0, 90)).astype(np.uint32)) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    want = [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in zip(a, b)]
    assert near_copies._shared(sets)(a, b).tolist() == want
    monkeypatch.setattr(near_copies, "TABLE_BYTES", 0)
    assert near_copies._shared(sets)(a, b).tolist() == want


def test_error_budget():
    assert near_copies.error_budget(1.0) == 0 and 22 <= near_copies.error_budget(0.8) <= 26
