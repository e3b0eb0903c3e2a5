import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import quality_cnn, queries


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in queries.op3_quality_classifier(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(out) == docs.count()
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    own = [i for i in labels if out[i]["held_out"]]
    good = [out[i]["score"] for i in own if labels[i] == 1]
    bad = [out[i]["score"] for i in own if labels[i] == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.9 and np.mean([s >= 0.7 for s in good]) > 0.9


def plain_score(model, text):
    """One position and one chunk at a time."""
    symbols = [*text, *[quality_cnn.PAD] * (max(2, -(-len(text) // quality_cnn.HALF)) * quality_cnn.HALF - len(text) + quality_cnn.WIDTH)]
    halves = (len(symbols) - quality_cnn.WIDTH) // quality_cnn.HALF
    chunks = []
    for c in range(halves - 1):
        best = None
        for at in range(c * quality_cnn.HALF, (c + 2) * quality_cnn.HALF, quality_cnn.STRIDE):
            x = np.concatenate([model.embedding[s] for s in symbols[at : at + quality_cnn.WIDTH]])
            z = x @ model.filters + model.bias
            best = z if best is None else np.maximum(best, z)
        chunks.append(np.maximum(best, 0))
    logit = np.mean(chunks, axis=0) @ model.out + model.shift[0]
    return 1 / (1 + np.exp(-logit))


def test_scores_are_those_of_the_definition_whatever_the_batch(monkeypatch):
    model = quality_cnn.Model(3)
    texts = [b"", b"a", b"some words " * 9, bytes(range(256)) * 5, b"x" * 256, b"y" * 257, "é中".encode() * 100]
    want = [plain_score(model, t) for t in texts]
    assert np.allclose(model.score(texts), want, atol=1e-5)
    monkeypatch.setattr(quality_cnn, "BLOCK_BYTES", 300)
    assert np.allclose(model.score(texts), want, atol=1e-5)
    assert np.allclose([model.score([t])[0] for t in texts], want, atol=1e-5)


def test_every_part_of_a_text_counts():
    good, bad = b"plain words of a text, ", b"$$$ ### !!! *** &&& "
    samples = [([good * 11], 1)] * 40 + [([bad * 12], 0)] * 40
    model = quality_cnn.train(samples)
    score = model.score([good * 300, bad * 300, good * 300 + bad * 300, bad * 300 + good * 300])
    assert score[0] > 0.7 > score[1] and score[2] < score[0] and score[3] < score[0]
    assert abs(score[2] - score[3]) < 0.05


@pytest.mark.parametrize("labels", [[], [1, 1], [0]])
def test_training_without_two_classes(labels):
    model = quality_cnn.train([([b"x"], y) for y in labels])
    assert np.isfinite(model.score([b"x", b""])).all()


def test_hard_rows(spark, docs, rows):
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(range(4, 17))] + [(4, None), (None, 1), (99, 1), (6, 5)], "doc_id bigint, quality int")
    model = quality_cnn.fit(docs, labels)
    out = quality_cnn.score(docs, model)
    assert set(out.columns) == set(docs.columns) and out.count() == len(rows)
    assert out.where(F.col("score").cast("double").between(0, 1)).count() == len(rows)
    assert quality_cnn.score(docs.limit(0), model).collect() == []
    again = quality_cnn.fit(docs, labels)
    assert all(np.array_equal(a, b) for a, b in zip(model.weights(), again.weights()))


def test_the_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(7, f"text number {k}") for k in range(300)] + [(k, "own") for k in range(100, 110)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0), *[(k, k % 2) for k in range(100, 110)]], "doc_id bigint, quality int")
    one, two = (quality_cnn.training_sample(d, labels, lambda i: i > 0, rows=20) for d in (docs, docs.repartition(7)))
    assert len(one) == 20 and one == two
