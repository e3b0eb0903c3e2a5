"""Near copies by word-shingle similarity: SimHash candidates in sampled buckets, and an exact check.

At a Jaccard similarity of 0.8 over five-word shingles, fingerprints of 64 bits differ by ten bits or so, too
many for buckets of equal bit blocks.  So documents meet in buckets of sampled shingles instead: each document
goes to the buckets of its ``ANCHORS`` smallest shingle hashes, and of two documents at 0.8 all but seven in a hundred
thousand share one.  In a bucket the binary trie self-join with an error budget of five deviations above the mean finds
the pairs worth a check (all but one in a million of those at 0.8), and the similarity of their shingle sets decides.
Fingerprints are voted over the distinct shingles, the same sets, so that lines repeated in one of two texts don't part them.

Copies count once, and so do buckets of the same documents: near copies share most of their anchors, and meet in
one bucket for all of them.  A bucket of too many documents (a line that many documents share) is cut by second
anchors: its documents meet where they share another of their ``CUT_ANCHORS`` smallest hashes, so many that of pairs at
0.8 under one in 10**9 doesn't.  What is still too large is dealt into blocks, each pair of blocks a task, so no pair is lost
and no task grows.  Only a spanning forest of a bucket's links leaves it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .components import components
from .simhash import fingerprint, shingle_hashes, trie_links, without, words

#: Sampled shingles of a document to cut a large bucket by; at 0.8 under one pair in 10**9 shares fewer than two.
CUT_ANCHORS = 16
#: Sampled shingles of a document; documents of a bucket before it is cut, and of a block after that.
ANCHORS, BUCKET_DOCS, BLOCK_DOCS = 6, 1000, 4000
#: Documents of a bucket that all others are compared with before the trie self-join, so that this needn't pair a group's members.
PIVOTS = 16
#: Candidate pairs looked at between two looks at what is joined already.
RUN = 1024
#: The most that a bucket's table of shared shingles may take.
TABLE_BYTES = 64 << 20
#: Bytes of that table gathered at a time, to compare pairs.
GATHER_BYTES = 4 << 20
#: Documents' buckets are broadcast, to fetch their texts, while there are so many bucket rows (of 24 bytes) in all at most.
BROADCAST_BUCKETS = 500_000


def error_budget(similarity: float, bits: int = 64, sigmas: float = 5.0) -> int:
    """Bits by which fingerprints of texts at a Jaccard similarity may differ: the mean, and some deviations more."""
    flip = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(bits * flip + sigmas * math.sqrt(bits * flip * (1 - flip)))


def sketches(df: DataFrame, size: int) -> DataFrame:
    """(doc_id, digest, fp, keys) of every text: the copies' key, the fingerprint, and the sampled shingles."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in slices(batches):
            digests, prints, keys = [], [], []
            for raw in batch.column(1).to_pylist():
                own = words(raw)
                hashes = np.unique(shingle_hashes(own, size))
                digests.append(xxh64_intdigest(b" ".join(own), 1))
                prints.append(fingerprint(hashes))
                keys.append(hashes[:CUT_ANCHORS].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "fp", "keys"])

    return df.mapInArrow(run, "doc_id bigint, digest bigint, fp bigint, keys array<bigint>")


def _met(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, n): the buckets of two documents or more; of buckets of the same documents, one.

    Buckets are the same if their sizes and two 64-bit hashes of their members are.
    """
    of = F.xxhash64("doc_id"), F.xxhash64("doc_id", F.lit(1))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(h).alias(f"x{k}") for k, h in enumerate(of)]).where("n > 1")
    return written(sizes.groupBy("n", "x0", "x1").agg(F.min(F.struct(*keys)).alias("k")).select("k.*", "n"), name)


def bucket_rows(distinct: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, b1, b2): the buckets, of two documents or more, in which distinct documents (doc_id, keys) meet."""
    rows = distinct.select("doc_id", "keys", F.explode(F.slice("keys", 1, ANCHORS)).alias("k1"))
    sizes = _met(rows, ["k1"], "bucket-sizes")
    shared = rows.join(sizes, "k1")
    zero = F.lit(0).cast("bigint")
    small = shared.where(F.col("n") <= BUCKET_DOCS).select("doc_id", "k1", zero.alias("k2"), F.lit(0).alias("b1"), F.lit(0).alias("b2"))
    if not sizes.where(F.col("n") > BUCKET_DOCS).take(1):
        return small
    # Documents of a large bucket meet where they share a second of more anchors; the pair's key is in order, so it is one bucket.
    both = shared.where(F.col("n") > BUCKET_DOCS).select("doc_id", "k1", F.explode("keys").alias("k2")).where("k1 <> k2")
    both = both.select("doc_id", F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")).distinct()
    # A document of one shingle has no second anchor, and copies counted once leave no other like it.
    cuts = _met(both, ["k1", "k2"], "bucket-cuts")
    met = both.join(cuts, ["k1", "k2"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK_DOCS).cast("int"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = met.withColumn("own", own).select("doc_id", "k1", "k2", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return small.unionByName(dealt.select("doc_id", "k1", "k2", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2")))


def _with_sets(docs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Bucket rows with each document's fingerprint and shingle set (ascending 64-bit hashes)."""
    owned = written(rows.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2", "b1", "b2")).alias("buckets")), "bucket-owners")
    n = owned.agg(F.sum(F.size("buckets"))).first()[0] or 0
    joined = docs.join(F.broadcast(owned) if n <= BROADCAST_BUCKETS else owned, "doc_id").select("doc_id", "text", "buckets")
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("b1", pa.int32()), ("b2", pa.int32()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in slices(batches, 32):
            out = []
            for row in batch.to_pylist():
                hashes = np.unique(shingle_hashes(words(row["text"]), size))
                own = {"doc_id": row["doc_id"], "fp": int(np.array([fingerprint(hashes)], np.uint64).view(np.int64)[0]), "shingles": hashes.tobytes()}
                out += [b | own for b in row["buckets"]]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return joined.mapInArrow(run, "k1 bigint, k2 bigint, b1 int, b2 int, doc_id bigint, fp bigint, shingles binary")


class _Bucket:
    """The documents of one bucket, and their links."""

    def __init__(self):
        self.ids, self.prints, self.sets = [], [], []

    def links(self, similarity: float, budget: int):
        """(id, smallest id of its group) of the documents linked to another."""
        order = np.argsort(np.array(self.prints, np.uint64), kind="stable")
        prints = np.array(self.prints, np.uint64)[order]
        sets = [np.frombuffer(self.sets[i], np.uint64) for i in order]
        ids = [self.ids[i] for i in order]
        sizes = np.array([len(s) for s in sets])
        shared = _shared(sets)
        labels = np.arange(len(ids))
        # A group of copies is one component after a few of these; pairs of different components are left to the trie.
        for _ in range(PIVOTS if len(ids) > PIVOTS else 0):
            alone = np.flatnonzero(labels == np.arange(len(ids)))
            alone = alone[np.bincount(labels, minlength=len(ids))[alone] == 1]
            if len(alone) < 2:
                break
            pivot = alone[len(alone) // 2]
            both = shared(np.full(len(ids), pivot), np.arange(len(ids)))
            alike = both >= similarity * (sizes[pivot] + sizes - both) - 1e-9
            alike[pivot] = True
            joined = np.unique(labels[alike])
            labels[np.isin(labels, joined)] = joined.min()
        for a, b in trie_links(prints, np.array([0, len(ids)]), budget, labels.copy()):
            near = (labels[a] != labels[b]) & (np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]))
            a, b = a[near], b[near]
            by_errors = np.argsort(np.bitwise_count(prints[a] ^ prints[b]), kind="stable")
            # Most pairs of a group of copies are joined by the time they are looked at, so they are dropped in runs.
            for at in range(0, len(a), RUN):
                run = by_errors[at : at + RUN]
                run = run[labels[a[run]] != labels[b[run]]]
                x, y = a[run], b[run]
                both = shared(x, y)
                alike = both >= similarity * (sizes[x] + sizes[y] - both) - 1e-9
                for i, j in zip(x[alike].tolist(), y[alike].tolist()):
                    if labels[i] != labels[j]:
                        labels[labels == max(labels[i], labels[j])] = min(labels[i], labels[j])
        least: dict[int, int] = {}
        for own, label in zip(ids, labels.tolist()):
            least[label] = min(least.get(label, own), own)
        return [(own, least[label]) for own, label in zip(ids, labels.tolist()) if own != least[label]]


def _shared(sets: list[np.ndarray]):
    """A function of two index arrays: how many elements the sets of each pair share.

    The elements that several sets have are numbered, and a set is a row of bits; where that table would pass
    TABLE_BYTES, pairs are counted one by one in the sorted sets.
    """
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    values, place, count = np.unique(every, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    width = (int((count > 1).sum()) + 63) // 64
    if len(sets) * width * 8 > TABLE_BYTES:
        return lambda a, b: np.array([_common(sets[i], sets[j]) for i, j in zip(a.tolist(), b.tolist())], np.int64)
    rows = np.zeros((len(sets), max(1, width)), np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = count[place] > 1
    bit = number[place[several]]
    np.bitwise_or.at(rows, (owner[several], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    step = max(1, GATHER_BYTES // rows[0].nbytes) if len(rows) else 1

    def count(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.empty(len(a), np.int64)
        for at in range(0, len(a), step):
            common = rows[a[at : at + step]]
            common &= rows[b[at : at + step]]
            both[at : at + step] = np.bitwise_count(common).sum(1, dtype=np.int64)
        return both

    return count


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two ascending sets share."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links(docs: DataFrame, rows: DataFrame, *, size: int, similarity: float) -> DataFrame:
    """(a, b): links between documents (doc_id, text) that together connect all similar ones that meet in a bucket."""
    budget = error_budget(similarity)

    def run(batches):
        key, bucket = None, _Bucket()
        for batch in slices(batches, 4096):
            found = []
            for row in batch.to_pylist():
                own = (row["k1"], row["k2"], row["b1"], row["b2"])
                if own != key:
                    found += bucket.links(similarity, budget)
                    key, bucket = own, _Bucket()
                bucket.ids.append(row["doc_id"])
                bucket.prints.append(row["fp"] % (1 << 64))
                bucket.sets.append(row["shingles"])
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])
        found = bucket.links(similarity, budget)
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    buckets = ["k1", "k2", "b1", "b2"]
    return _with_sets(docs, rows, size).repartition(*buckets).sortWithinPartitions(*buckets).mapInArrow(run, "a bigint, b bigint")


def near_groups(df: DataFrame, *, words_per_shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every document with an id: the smallest id of its group of copies and near copies.

    Texts whose words are equal but for ASCII case and white space are copies; empty and null texts are copies
    of each other.  Near copies have a Jaccard similarity of ``similarity`` or more over their distinct shingles
    (all the words of a shorter text).  Rows without an id are in no group; rows that share an id are one document.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("doc_id is not null")
    marked = written(sketches(docs, words_per_shingle), "sketches")
    first = F.min_by(F.struct("doc_id", "keys"), "doc_id")
    copies = written(marked.groupBy("digest", "fp").agg(F.min("doc_id").alias("least"), first.alias("one")), "copies")
    distinct = copies.select("least", "one.keys").groupBy(F.col("least").alias("doc_id")).agg(F.min("keys").alias("keys"))
    rows = written(bucket_rows(distinct), "buckets")
    labels = components(links(docs, rows, size=words_per_shingle, similarity=similarity))
    owned = copies.select("digest", "fp", "least").join(labels.withColumnRenamed("node", "least"), "least", "left").select("digest", "fp", F.coalesce("label", "least").alias("component_id"))
    return marked.select("doc_id", "digest", "fp").join(owned, ["digest", "fp"]).select("doc_id", "component_id")


def near_dedup(df: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows and columns of ``df`` less every document but the one of the smallest id in its group; rows without an id stay."""
    grouped = near_groups(df, id_col=id_col, **options)
    removed = written(grouped.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return without(df, removed, id_col)
