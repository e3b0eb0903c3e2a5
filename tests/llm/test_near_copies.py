import random

import numpy as np

from wardline.llm import near_copies, simhash
from wardline.llm.common import written


def linked(spark, texts, name):
    """Groups of the texts by their places."""
    df = written(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), name)
    return {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(df).collect()}


def test_a_repeated_line_does_not_part_near_copies(spark):
    r = random.Random(4)
    texts = []
    for k in range(40):
        base = [f"w{r.randrange(10**6)}" for _ in range(300)]
        line = [f"w{r.randrange(10**6)}" for _ in range(8)]
        texts += [" ".join(base), " ".join(base + line * (10 + k))]
    assert linked(spark, texts, "repeated-lines") == {k: k - k % 2 for k in range(len(texts))}


def test_pairs_that_share_one_anchor_are_found_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BUCKET_DOCS", 1)
    r = random.Random(8)
    texts = []
    while len(texts) < 8:
        whole = [f"w{r.randrange(10**9)}" for _ in range(64)]
        part = whole[:52]
        a, b = (np.unique(simhash.shingle_hashes([w.encode() for w in x], 5)) for x in (whole, part))
        prints = np.uint64(simhash.fingerprint(a)) ^ np.uint64(simhash.fingerprint(b))
        if len(np.intersect1d(a[:6], b[:6])) == 1 and np.bitwise_count(prints) <= near_copies.error_budget(0.8):
            assert len(np.intersect1d(a, b)) >= 0.8 * len(a)
            texts += [" ".join(whole), " ".join(part)]
    assert linked(spark, texts, "one-anchor") == {k: k - k % 2 for k in range(len(texts))}


def jaccard_groups(texts):
    """Groups by brute force: every pair's similarity over five-word shingles, spelled out."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    labels = list(range(len(texts)))
    pairs = []
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                pairs.append((j, i))
                a, b = labels[i], labels[j]
                labels = [min(a, b) if x in (a, b) else x for x in labels]
    return labels, pairs


def corpus(seed, n, shared):
    """Texts and edited copies of them at similarities around 0.8; ``shared`` is a line that all have."""
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([30, 80, 200, 400]))] + shared
        texts.append(base)
        for _ in range(r.randrange(4)):
            copy = list(r.choice(texts[-2:]))
            for _ in range(max(1, round(len(copy) * r.uniform(0.002, 0.03)))):
                copy[r.randrange(len(copy))] = f"w{r.randrange(10**6)}"
            texts.append(copy)
    return [" ".join(t) for t in texts]


def recall(got, pairs):
    return sum(got[a] == got[b] for a, b in pairs) / len(pairs)


def test_links_at_the_threshold_against_brute_force(spark):
    texts = corpus(21, 150, [])
    labels, pairs = jaccard_groups(texts)
    got = linked(spark, texts, "threshold")
    assert len(pairs) > 100 and recall(got, pairs) >= 0.995
    assert all(labels[i] == labels[got[i]] for i in range(len(texts)))


def test_links_in_large_buckets_against_brute_force(spark, monkeypatch):
    """A line that every text has makes buckets of all of them; they are cut, and dealt to blocks."""
    r = random.Random(1)
    line = [f"s{r.randrange(10**6)}" for _ in range(25)]
    texts = corpus(22, 150, line)
    labels, pairs = jaccard_groups(texts)
    for docs, block in ((1000, 4000), (20, 4000), (20, 30)):
        monkeypatch.setattr(near_copies, "BUCKET_DOCS", docs)
        monkeypatch.setattr(near_copies, "BLOCK_DOCS", block)
        got = linked(spark, texts, f"large-{docs}-{block}")
        assert len(pairs) > 100 and recall(got, pairs) >= 0.995
        assert all(labels[i] == labels[got[i]] for i in range(len(texts)))


def test_documents_of_the_table_against_brute_force(spark):
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    texts = [t or "" for _, t in rows]
    labels, pairs = jaccard_groups(texts)
    got = linked(spark, texts, "table")
    assert [got[i] for i in range(len(texts))] == labels and pairs


def test_equal_fingerprints_are_all_compared():
    """Of documents with one fingerprint, or on two leaves within the budget, every pair is checked, not only the first."""
    assert near_copies._Bucket().links(0.8, 18) == []
    far, one, other = (np.arange(k, k + 100, dtype=np.uint64) for k in (1000, 0, 5))
    for prints in ((5, 5, 5), (5, 4, 5), (4, 4, 5), (4, 5, 5)):
        bucket = near_copies._Bucket()
        bucket.ids, bucket.prints, bucket.sets = [7, 8, 9], list(prints), [x.tobytes() for x in (far, one, other)]
        assert bucket.links(0.8, 18) == [(9, 8)]


def test_links_of_a_bucket_against_every_pair(monkeypatch):
    """Groups with and without pivots are those of all pairs within the budget, with many equal fingerprints."""
    r = random.Random(5)
    bases = [[b"w%d" % r.randrange(10**6) for _ in range(120)] for _ in range(4)]
    bucket = near_copies._Bucket()
    for k in range(150):
        text = list(bases[k % 4])
        for _ in range(r.randrange(1, 5)):
            text[r.randrange(len(text))] = b"x%d" % r.randrange(10**6)
        hashes = np.unique(simhash.shingle_hashes(text, 5))
        bucket.ids.append(k)
        bucket.prints.append(simhash.fingerprint(hashes))
        bucket.sets.append(hashes.tobytes())
    sets = [set(np.frombuffer(x, np.uint64).tolist()) for x in bucket.sets]
    labels = list(range(150))
    for i in range(150):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = labels[i], labels[j]
                labels = [min(a, b) if x in (a, b) else x for x in labels]
    for pivots in (0, 1, 16):
        monkeypatch.setattr(near_copies, "PIVOTS", pivots)
        got = dict(bucket.links(0.8, 64))
        assert [got.get(k, k) for k in range(150)] == labels


def test_a_large_bucket_takes_little_memory():
    import tracemalloc

    r = np.random.default_rng(6)
    bucket = near_copies._Bucket()
    bucket.ids, bucket.prints = list(range(3000)), [int(x) for x in r.integers(0, 1 << 63, 3000, np.uint64) * np.uint64(2)]
    bucket.sets = [np.unique(r.integers(0, 40_000, 60, np.uint64)).tobytes() for _ in range(3000)]
    tracemalloc.start()
    assert bucket.links(0.8, near_copies.error_budget(0.8)) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
