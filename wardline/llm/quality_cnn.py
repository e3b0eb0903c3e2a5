"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over the whole document, their responses are max-pooled in overlapping
chunks, and a document's probability is a logistic function of the mean over its chunks.  The chunks cover the
document, whatever its length; bytes after its end are a padding byte of their own embedding.

Training reads a bounded sample of labelled rows (``SAMPLE_ROWS``) and of each row's chunks (``SAMPLE_CHUNKS``,
drawn over the whole text); scoring reads everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes of a half chunk (chunks overlap by one half), bytes that a filter sees, its step, sizes of the layers.
HALF, WIDTH, STRIDE, EMBED, FILTERS = 128, 8, 2, 6, 20
#: The padding byte's row in the embedding.
PAD = 256
SAMPLE_ROWS, SAMPLE_CHUNKS = 4000, 6
#: Of every so many samples one is also learned from a short piece alone, since short texts are few.
SHORT_EVERY = 2
EPOCHS, BATCH, RATE, DECAY = 7, 64, 4e-3, 1e-5
#: A small sample is gone through more often, to make so many steps.
MIN_STEPS = 350
#: Bytes scored at a time.
BLOCK_BYTES = 1 << 19


class Model:
    """Weights: embedding (257, EMBED), filters (WIDTH * EMBED, FILTERS) and bias, output weights and bias."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embedding = r.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.embedding[PAD] = 0
        self.filters = r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.3, FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.shift]

    def _responses(self, symbols: np.ndarray, count: int) -> np.ndarray:
        """Filter responses (count, FILTERS) at every STRIDE-th position of one run of symbols."""
        x = self.embedding[symbols].reshape(-1)
        step = x.strides[0]
        windows = np.lib.stride_tricks.as_strided(x, (count, WIDTH * EMBED), (STRIDE * EMBED * step, step))
        return windows @ self.filters

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The probability of each whole text."""
        if not texts:
            return np.zeros(0)
        # A half of padding after each text keeps windows at its end off the next one; it is in no chunk.
        halves = np.array([max(2, -(-len(t) // HALF)) + 1 for t in texts])
        ends = np.cumsum(halves)
        symbols = np.full(int(ends[-1]) * HALF + WIDTH, PAD, np.int16)
        for t, end, n in zip(texts, ends, halves):
            at = (end - n) * HALF
            symbols[at : at + len(t)] = np.frombuffer(t, np.uint8)
        total, per = int(ends[-1]), HALF // STRIDE
        pooled = np.empty((total, FILTERS), np.float32)
        block = max(1, BLOCK_BYTES // HALF)
        for at in range(0, total, block):
            n = min(block, total - at)
            pooled[at : at + n] = self._responses(symbols[at * HALF : (at + n) * HALF + WIDTH], n * per).reshape(n, per, FILTERS).max(1)
        # A chunk is two adjacent halves; a document of n halves and one of padding has n - 1 chunks.
        chunks = np.maximum(np.maximum(pooled[:-1], pooled[1:]) + self.bias, 0)
        starts = ends - halves
        sums = np.add.reduceat(np.concatenate([chunks, np.zeros((1, FILTERS), np.float32)]).astype(np.float64) * _inner(starts, ends)[:, None], starts, axis=0)
        logits = sums / (halves - 2)[:, None] @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def _inner(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for each half that begins a chunk of its own document, 0 for each document's last half and its padding."""
    out = np.ones(int(ends[-1]), np.float64)
    out[ends - 1] = out[ends - 2] = 0
    return out


def chunks_of(text: bytes, most: int, seed: int) -> list[bytes]:
    """``most`` chunks of a text at most, drawn over the whole of it."""
    count = max(1, -(-len(text) // HALF) - 1)
    picked = np.arange(count) if count <= most else np.sort(np.random.default_rng(seed).choice(count, most, replace=False))
    return [text[k * HALF : k * HALF + 2 * HALF] for k in picked.tolist()]


def train(samples: list[tuple[list[bytes], int]], seed: int = 7) -> Model:
    """Fit to (chunks, label) samples by Adam; the rarer class counts more.  With one class or none the model is a constant."""
    model = Model(seed)
    labels = np.array([y for _, y in samples], np.float32)
    if len(set(labels.tolist())) < 2:
        model.out[:] = 0
        model.shift[:] = 0 if not len(labels) else 4 * (2 * labels[0] - 1)
        return model
    r, short = np.random.default_rng(seed), []
    for chunks, label in samples[::SHORT_EVERY]:
        piece = chunks[int(r.integers(len(chunks)))]
        at = int(r.integers(max(1, len(piece) - 8)))
        cut = piece[at : at + int(6 * 20 ** r.random())]
        short.append(([cut], label))
    samples = samples + short
    labels = np.array([y for _, y in samples], np.float32)
    size = 2 * HALF
    n_chunks = np.array([len(c) for c, _ in samples])
    first = np.cumsum(n_chunks) - n_chunks
    symbols = np.full((int(n_chunks.sum()), size + WIDTH), PAD, np.int16)
    for row, chunk in enumerate(c for own, _ in samples for c in own):
        symbols[row, : len(chunk)] = np.frombuffer(chunk, np.uint8)
    # Half way between as they are and as many of each: the rarer class counts more, but not so much that doubt is in its favour.
    balance = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean()).astype(np.float32) ** 0.5
    per = size // STRIDE
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights()]
    step = 0
    epochs = max(EPOCHS, -(-MIN_STEPS * BATCH // len(samples)))
    for epoch in range(epochs):
        order = r.permutation(len(samples))
        rate = RATE * (1 - epoch / epochs) + RATE / 20
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            own = n_chunks[docs]
            rows = np.concatenate([np.arange(first[d], first[d] + n_chunks[d]) for d in docs])
            doc = np.repeat(np.arange(len(docs)), own)
            seen = symbols[rows]
            x = model.embedding[seen]
            flat = x.reshape(len(rows), -1)
            step_bytes = flat.strides[1]
            windows = np.lib.stride_tricks.as_strided(flat, (len(rows), per, WIDTH * EMBED), (flat.strides[0], STRIDE * EMBED * step_bytes, step_bytes))
            z = windows.reshape(-1, WIDTH * EMBED) @ model.filters
            z = z.reshape(len(rows), per, FILTERS)
            best = z.argmax(1)
            top = np.take_along_axis(z, best[:, None], 1)[:, 0] + model.bias
            relu = np.maximum(top, 0)
            mean = np.zeros((len(docs), FILTERS), np.float32)
            np.add.at(mean, doc, relu)
            mean /= own[:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ model.out + model.shift, -40, 40)))
            d_logit = (p - labels[docs]) * balance[docs] / len(docs)
            d_out = mean.T @ d_logit
            d_top = (d_logit[:, None] * model.out / own[:, None])[doc] * (top > 0)
            picked = windows[np.arange(len(rows))[:, None], best]  # (rows, FILTERS, WIDTH * EMBED)
            d_filters = np.einsum("rfk,rf->kf", picked, d_top, optimize=True)
            d_windows = d_top[:, :, None] * model.filters.T[None]
            d_embedding = np.zeros_like(model.embedding)
            places = seen[np.arange(len(rows))[:, None, None], (best * STRIDE)[:, :, None] + np.arange(WIDTH)]
            np.add.at(d_embedding, places.reshape(-1), d_windows.reshape(-1, EMBED))
            step += 1
            grads = [d_embedding, d_filters, d_top.sum(0), d_out.astype(np.float32), np.array([d_logit.sum()], np.float32)]
            for w, g, (m, v) in zip(model.weights(), grads, moments):
                g = g + DECAY * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, allowed, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> list[tuple[list[bytes], int]]:
    """At most ``rows`` labelled documents (lowest hash of the id first) for which ``allowed`` holds, as chunk samples.

    Rows that share an id are documents of their own, each with the id's labels.
    """
    picked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & allowed(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)
    # At most ``rows`` rows of two numbers: the broadcast's size is bounded.
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).join(F.broadcast(picked), "_id")

    def cut(batches):
        for batch in slices(batches):
            ids, texts, marks = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([chunks_of(t or b"", SAMPLE_CHUNKS, len(t or b"")) for t in texts], pa.list_(pa.binary())), pa.array(marks, pa.int32())], names=["id", "chunks", "label"])

    # Where ids repeat, more rows than were picked may join; the sample stays as small as it is said to be.
    made = joined.select(F.col("_id").cast("string"), "_text", "_label").mapInArrow(cut, "id string, chunks array<binary>, label int")
    found = made.orderBy(F.xxhash64("id"), F.xxhash64("chunks"), "id", "label").limit(rows).toArrow()
    rows_ = zip(found["id"].to_pylist(), found["chunks"].to_pylist(), found["label"].to_pylist())
    return [(chunks, label) for _, chunks, label in sorted(rows_, key=lambda x: (x[0] or "", x[1], x[2]))]


def fit(docs: DataFrame, labels: DataFrame, allowed=lambda c: F.lit(True), **columns) -> Model:
    return train(training_sample(docs, labels, allowed, **columns))


def score(df: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The input's rows and columns with ``score_col`` (0 to 1), in place of a column of that name.

    Only the text counts.  A null text is scored as an empty one, which is all padding.
    """
    df = df.drop(score_col)
    kept = df.columns
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("binary").alias("__scored"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            values = shared.value.score([t or b"" for t in batch.column(len(kept)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())], names=[*batch.schema.names[:-1], score_col])

    return source.mapInArrow(run, df.withColumn(score_col, F.lit(0.0)).schema)
