import math
import random

import duckdb
import numpy as np
import pytest

from wardline.llm import queries, topk_search


def plain(rows, k=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    scores = {}
    for i, q in good:
        if i % 20 == 0:
            scores.setdefault(i, []).extend((-min((1 << 63) - 1, max(2 - (1 << 63), sum(a * b for a, b in zip(q, v)))), j) for j, v in good if j != i and len(v) == len(q))
    return sorted((i, n, j, -s) for i, own in scores.items() for n, (s, j) in enumerate(sorted(own)[:k], 1))


def search(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, id int, score int")
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(df.repartition(3), lambda i: i % 20 == 0).collect())


def vectors(n, dims, seed, spread=1.0):
    r = np.random.default_rng(seed)
    return [[float(x) for x in np.float32(v)] for v in r.normal(0, spread, (n, dims))]


@pytest.mark.parametrize("dims", [1, 7, 16, 40, 64])
def test_against_brute_force(spark, dims):
    rows = list(enumerate(vectors(300, dims, dims)))
    assert search(spark, rows) == plain(rows)


def test_ties_odd_vectors_and_few_candidates(spark):
    base = [1.0, -0.5, 0.25]
    rows = [(i, base) for i in range(60)] + [(60, None), (80, [1.0, None, 2.0]), (100, [1.0, float("nan"), 2.0]), (120, [float("inf"), 0.0, 0.0]), (140, []), (None, base), (160, [1.0, 2.0]), (161, [3.0, 4.0]), (180, [0.0, 0.0, 0.0]), (200, [1.0])]
    random.Random(1).shuffle(rows)
    assert search(spark, rows) == plain(rows)


def test_large_components_stay_exact(spark):
    rows = list(enumerate(vectors(120, 20, 3, spread=200_000.0)))
    assert search(spark, rows) == plain(rows)


def test_components_of_any_size_take_part(spark):
    rows = list(enumerate(vectors(60, 5, 4)))
    big = [2.0**20, -(2.0**30), 2.0**47, 2.0**64, -(2.0**100), 2.0**127]
    rows += [(100 + 10 * k, [x, 1.0, -0.5, 0.25, 2.0]) for k, x in enumerate(big)] + [(200, []), (201, []), (220, [0.0] * 5)]
    assert search(spark, rows) == plain(rows)
    assert {r[2] for r in search(spark, rows)} >= {100, 110, 120, 130, 140, 150, 201}


def test_repeated_rows_and_ids(spark, monkeypatch):
    rows = list(enumerate(vectors(50, 6, 9)))
    rows += [(20, v) for v in vectors(3, 6, 10)] + [rows[0], rows[0], rows[7], rows[7]]
    assert search(spark, rows) == plain(rows)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk_search, "PLAN_BLOCKS", 2)
    assert search(spark, rows) == plain(rows)


def test_query_blocks_and_candidate_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    rows = list(enumerate(vectors(200, 32, 8)))
    assert search(spark, rows) == plain(rows)


def test_empty(spark):
    assert search(spark, [(1, [1.0])]) == []
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk_search.top_k(df, lambda i: i % 20 == 0).collect() == []


def test_bounds_prune(monkeypatch):
    r = np.random.default_rng(0)
    columns = np.floor(r.normal(0, 8, (64, 4000)))
    columns[:, :50] *= 6
    q = columns[:, :8].T.copy()
    best = topk_search.Best(8, 5)
    lengths = topk_search._left(q.T).T
    for at in range(0, 4000, 500):
        topk_search.scan_block(q, np.arange(8), lengths, columns[:, at : at + 500], np.arange(at, at + 500), best)
    scores = q @ columns
    scores[np.arange(8), np.arange(8)] = -np.inf
    want = np.lexsort((np.broadcast_to(np.arange(4000), scores.shape), -scores), axis=1)[:, :5]
    assert best.ids.tolist() == want.tolist()


def test_the_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    out = queries.op1_topk_search(spark, sf)
    want = con.execute(queries.SQL["op1_topk_search"])
    assert out.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, out.collect())) == sorted(want.fetchall())
