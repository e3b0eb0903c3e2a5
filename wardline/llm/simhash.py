"""SimHash fingerprints of word shingles, and their near-duplicate links by a binary trie self-join.

Distinct fingerprints (copies count once) go to buckets: with an error budget of e, two linked fingerprints
agree in at least one of e + 1 disjoint blocks of bits, so each fingerprint goes to one bucket for each block,
keyed by that block's bits.  A bucket that is too large is cut again the same way by its other bits, for those
fingerprints only, until the bits that are left bound its size.  In every bucket the sorted fingerprints are a
binary trie, and pairs of its nodes are traversed together, all pairs of a depth at once: children that differ
in their bit add one error, a pair beyond the budget is pruned, and what remains at the leaves are the links.

Only a spanning forest of each task's links leaves it, so a group of n copies gives n - 1 rows, not n * n / 2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .components import components

BITS = 64
#: Hash seed of a shingle.
SEED = 42
#: A bucket beyond so many distinct fingerprints is cut by further bits; at the last level 2 ** 19 are possible.
BUCKET_ROWS = 2048
LEVELS = 3
#: Node pairs traversed at a time: of their up to four times as many children, some copies are held at once (of 33 bytes each).
FRONTIER = 1 << 16
#: Pairs of leaves whose members are paired at a time.
LEAF_PAIRS = 1 << 16

# Fixed: ASCII capitals become small; words are separated by space and 09-0D.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def shingle_hashes(own: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words joined by spaces, repeats included; fewer words are one shingle."""
    from xxhash import xxh64_intdigest

    if not own:
        return np.zeros(0, np.uint64)
    text = b" ".join(own)
    if len(own) <= size:
        return np.array([xxh64_intdigest(text, SEED)], np.uint64)
    ends, at = [], -1
    for w in own:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-size]]]
    return np.array([xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if over half the hashes have it; no hashes give zero."""
    if not len(hashes):
        return 0
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, *, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep`` and ``fp`` (the fingerprint as a signed bigint) of every whole text; a null text has none of words."""
    source = df.select(*[F.col(f"`{c}`") for c in (id_col, *keep)], F.col(f"`{text_col}`").cast("binary").alias("__text"))
    schema = source.drop("__text").withColumn("fp", F.lit(0).cast("bigint")).schema

    def run(batches):
        for batch in slices(batches):
            values = np.array([fingerprint(shingle_hashes(words(t), words_per_shingle)) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return source.mapInArrow(run, schema)


def block_masks(free: list[int], blocks: int) -> list[int]:
    """Masks of ``blocks`` disjoint blocks over the bit positions in ``free``."""
    cuts = [round(len(free) * i / blocks) for i in range(blocks + 1)]
    return [sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def mask_levels(budget: int) -> list[list[tuple[int, list[int]]]]:
    """For each level, (mask, numbers of its masks on the next level)."""
    level = block_masks(list(range(BITS)), budget + 1)
    out = []
    for depth in range(LEVELS):
        below, rows = [], []
        for mask in level:
            children = []
            if depth + 1 < LEVELS:
                for extra in block_masks([b for b in range(BITS) if not mask >> b & 1], budget + 1):
                    children.append(len(below))
                    below.append(mask | extra)
            rows.append((mask, children))
        out.append(rows)
        level = below
    return out


def buckets(prints: DataFrame, budget: int, limit: int = BUCKET_ROWS) -> DataFrame:
    """(level, mask, value, fp): every distinct fingerprint in its buckets, large ones cut again."""
    spark = prints.sparkSession
    levels = mask_levels(budget)

    def keyed(numbers: list[int], masks: list[int]):
        return F.array(*[F.struct(F.lit(n).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("value")) for n, m in zip(numbers, masks)])

    now = prints.select("fp", F.explode(keyed(list(range(len(levels[0]))), [m for m, _ in levels[0]])).alias("k")).select("fp", "k.mask", "k.value")
    out = None
    for depth, masks in enumerate(levels):
        last, part = depth + 1 == LEVELS, now
        if not last:
            large = written(now.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("mask", "value"), "large-buckets")
            last = not large.take(1)
            part = now if last else now.join(large, ["mask", "value"], "left_anti")
        part = part.select(F.lit(depth).alias("level"), "mask", "value", "fp")
        out = part if out is None else out.unionByName(part)
        if last:
            break
        hot = now.join(large, ["mask", "value"], "left_semi")
        nxt = [m for m, _ in levels[depth + 1]]
        choice = None
        for number, (_, children) in enumerate(masks):
            own = keyed(children, [nxt[c] for c in children])
            choice = F.when(F.col("mask") == number, own) if choice is None else choice.when(F.col("mask") == number, own)
        # A fingerprint may be in several large buckets, each with masks of its own.
        now = hot.select("fp", F.explode(choice).alias("k")).select("fp", "k.mask", "k.value")
    return out


def trie_links(prints: np.ndarray, runs: np.ndarray, budget: int, groups: np.ndarray | None = None):
    """Links (index arrays) between fingerprints of one run at ``budget`` differing bits at most.

    ``prints`` (uint64) ascends within each run; ``runs`` has the runs' starts and the total.  Yields arrays.
    Without ``groups``, of equal fingerprints only the first is linked to others: that connects the same.  With ``groups``
    (a label of each) every pair comes that isn't of one group, and node pairs whose leaves are all of one are left out.
    """
    if groups is not None and len(groups):
        starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        # Where the run of equal labels that each fingerprint is in ends.
        until = np.repeat(np.append(starts[1:], len(groups)), np.diff(np.append(starts, len(groups))))
    lo, hi = runs[:-1][np.diff(runs) > 1], runs[1:][np.diff(runs) > 1]
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if groups is not None and len(alo):
            mixed = (until[alo] < ahi) | (until[blo] < bhi) | (groups[alo] != groups[blo])
            alo, ahi, blo, bhi, err = (x[mixed] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(depth, *(x[:half] for x in (alo, ahi, blo, bhi, err))), (depth, *(x[half:] for x in (alo, ahi, blo, bhi, err)))]
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            a, b = alo[single], blo[single]
            near = np.bitwise_count(prints[a] ^ prints[b]) <= budget
            yield a[near], b[near]
            rest = ~single
            alo, ahi, blo, bhi, err = (x[rest] for x in (alo, ahi, blo, bhi, err))
        if depth == BITS or not len(alo):
            if len(alo) and groups is not None:
                for at in range(0, len(alo), LEAF_PAIRS):
                    yield from _leaf_pairs(*(x[at : at + LEAF_PAIRS] for x in (alo, ahi, blo, bhi)))
            elif len(alo):
                # Equal prints only: the sides are one leaf's copies, chained to its first.
                for x, y, u, v in zip(alo.tolist(), ahi.tolist(), blo.tolist(), bhi.tolist()):
                    every = np.unique(np.concatenate([np.arange(x, y), np.arange(u, v)]))
                    yield np.full(len(every) - 1, every[0]), every[1:]
            continue
        bit = np.uint64(BITS - 1 - depth)
        amid, bmid = _split(prints, alo, ahi, bit), _split(prints, blo, bhi, bit)
        own = alo == blo
        other = ~own
        parts = [
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            (alo, amid, bmid, bhi, err + 1),
            (amid[other], ahi[other], blo[other], bmid[other], err[other] + 1),
        ]
        joined = [np.concatenate([p[k] for p in parts]) for k in range(5)]
        alo, ahi, blo, bhi, err = joined
        keep = (ahi > alo) & (bhi > blo) & (err <= budget) & ((alo != blo) | (ahi - alo > 1))
        stack.append((depth + 1, *(x[keep] for x in joined)))


def _leaf_pairs(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray):
    """Every pair between two leaves' ranges, or within the one; arrays of about FRONTIER pairs or one row of them."""
    rows = ahi - alo
    a = np.arange(int(rows.sum())) + np.repeat(alo - (np.cumsum(rows) - rows), rows)
    lo, hi = np.where(np.repeat(alo == blo, rows), a + 1, np.repeat(blo, rows)), np.repeat(bhi, rows)
    n = hi - lo
    total = np.cumsum(n)
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + FRONTIER, "right")))
        own, before = n[at:end], total[at:end] - n[at:end] - (total[at - 1] if at else 0)
        yield np.repeat(a[at:end], own), np.arange(int(own.sum())) + np.repeat(lo[at:end] - before, own)
        at = end


def _split(prints: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Of each range, which shares the bits above ``bit``: where the ones begin (binary search in step)."""
    left, right = lo.copy(), hi.copy()
    while (open_ := left < right).any():
        mid = (left + right) >> 1
        one = prints[np.minimum(mid, len(prints) - 1)] >> bit & np.uint64(1) == 1
        right = np.where(open_ & one, mid, right)
        left = np.where(open_ & ~one, mid + 1, left)
    return left


def forest(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Labels (the smallest index reachable) of n nodes under links, on top of earlier labels."""
    labels = np.arange(n) if labels is None else labels
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := labels[labels], labels):
            labels = up


def _task_links(batches, budget: int):
    parts = [(b.column("mask").to_numpy(zero_copy_only=False), b.column("value").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False)) for b in batches]
    if not parts:
        return
    mask, value, fp = (np.concatenate([p[k] for p in parts]) for k in range(3))
    prints = fp.view(np.uint64)
    order = np.lexsort((prints, value, mask))
    mask, value, prints = mask[order], value[order], prints[order]
    n = len(prints)
    runs = np.concatenate([[0], np.flatnonzero((np.diff(mask) != 0) | (np.diff(value) != 0)) + 1, [n]])
    # The same fingerprint in several of the task's buckets is one node.
    distinct, node = np.unique(prints, return_inverse=True)
    labels = np.arange(len(distinct))
    for a, b in trie_links(prints, runs, budget):
        if len(a):
            labels = forest(len(distinct), node[a], node[b], labels)
    linked = np.flatnonzero(labels != np.arange(len(distinct)))
    if len(linked):
        yield pa.RecordBatch.from_arrays([pa.array(distinct[linked].view(np.int64)), pa.array(distinct[labels[linked]].view(np.int64))], names=["a", "b"])


def links(prints: DataFrame, budget: int, limit: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that together connect all that are ``budget`` bits apart or fewer."""
    rows = buckets(prints, budget, limit).withColumn("mask", F.col("level") * 1000 + F.col("mask")).select("mask", "value", "fp")
    return rows.repartition("mask", "value").mapInArrow(lambda batches: _task_links(batches, budget), "a bigint, b bigint")


def near_groups(df: DataFrame, *, words_per_shingle: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    Equal fingerprints are linked too; empty and null texts have fingerprint zero, linked like any other.  Ids
    may be null or repeat: a null is nobody's smallest id unless all are null, and then the component is null.
    Other columns are not read.
    """
    prints = written(fingerprints(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), words_per_shingle=words_per_shingle), "fingerprints")
    return grouped(prints, budget).select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def grouped(prints: DataFrame, budget: int) -> DataFrame:
    """``prints`` (doc_id, fp, ...) with component_id."""
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-groups")
    labels = components(links(groups.select("fp"), budget))
    named = groups.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left")
    least = named.where("label is not null").groupBy("label").agg(F.min("least").alias("all_least"))
    owned = named.join(least, "label", "left").select("fp", F.coalesce("all_least", "least").alias("component_id"))
    return prints.join(owned, "fp", "left")


#: At most so many ids of removed documents are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(df: DataFrame, removed: DataFrame, id_col: str) -> DataFrame:
    """``df`` less the rows whose id is in ``removed`` (column doc_id): a broadcast while its counted size is bounded."""
    ids = removed.select(F.col("doc_id").alias(id_col))
    return df.join(F.broadcast(ids) if removed.count() <= BROADCAST_IDS else ids, id_col, "left_anti")

