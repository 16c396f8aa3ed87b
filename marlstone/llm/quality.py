"""Quality classifier: a byte-level convolutional network in numpy (operator 1).

Bytes are embedded; learned filters of ``WIDTH`` bytes move by ``STRIDE`` bytes
over the whole document, so that neighbouring windows overlap; activations are
max-pooled over chunks of ``CHUNK`` windows, a small dense layer combines the
maxima of a chunk, and the mean and the maximum of its units over a document's
chunks meet in one logistic output. A window looks past the end of
its chunk, so chunks overlap too and nothing falls between two of them.

Training is on the driver, over a bounded sample: at most ``most_per_class``
labelled documents a class, those with the smallest hash of their doc_id. Of a text of more than
``MOST_TRAINED`` bytes, so many are trained on, in pieces spread evenly over the whole of it. Class weights restore the proportions
of all training labels. Scoring reads every whole text.

Defined cases: null and empty texts are scored as an empty document (padding
alone); rows that repeat give equal rows; of rows that repeat a labelled doc_id one trains, that of the least hash of its text;
very long texts are scored in slabs; a label table without training rows
gives the constant score 0.5; an empty table gives an empty result; other columns are ignored by :func:`train` and stay as they are in :func:`keep`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, table, text_or_empty

EMBED, WIDTH, STRIDE, FILTERS, CHUNK, HIDDEN = 8, 8, 4, 48, 64, 24
#: Bytes convolved at once; longer documents come in slabs of whole chunks.
SLAB = 1 << 17
MOST_PER_CLASS, MOST_TRAINED = 1500, 40_960
EPOCHS, BATCH, RATE, SEED, THRESHOLD = 10, 32, 4e-3, 7, 0.3


def _blocks(raw: bytes) -> np.ndarray:
    """Bytes (shifted by one, 0 pads) in rows of STRIDE, with one row of padding at the end."""
    n = -(-max(1, len(raw)) // STRIDE) * STRIDE + (WIDTH - STRIDE)
    out = np.zeros(n, dtype=np.int16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    out[: len(raw)] += 1
    return out.reshape(-1, STRIDE)


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.embed = rng.normal(0, 0.5, (257, EMBED)).astype(f)
        self.embed[0] = 0
        self.filters = rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(f)
        self.bias = np.zeros(FILTERS, dtype=f)
        self.dense = rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(f)
        self.dense_bias = np.zeros(HIDDEN, dtype=f)
        self.out = rng.normal(0, 0.1, 2 * HIDDEN).astype(f)
        self.shift = np.zeros(1, dtype=f)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.dense_bias, self.out, self.shift]

    def convolve(self, blocks: np.ndarray) -> np.ndarray:
        """Activations of the windows that start at each row but the last."""
        x = self.embed[blocks.reshape(-1)].reshape(len(blocks), STRIDE * EMBED)
        half = STRIDE * EMBED
        y = x[:-1] @ self.filters[:half]
        y += x[1:] @ self.filters[half:]
        y += self.bias
        return np.maximum(y, 0, out=y)

    def document_vectors(self, raws: list[bytes]) -> np.ndarray:
        """Mean and maximum of the chunks' units for each document."""
        n = len(raws)
        total, top, count = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros(n, np.int64)
        slab, starts, owners, size = [], [], [], 0

        def flush():
            nonlocal slab, starts, owners, size
            y = self.convolve(np.concatenate([*slab, np.zeros((1, STRIDE), np.int16)]))
            # each chunk is [start, end); what lies between two documents falls to odd places and is left out
            edges = np.array(starts).reshape(-1)
            chunk = np.maximum(np.maximum.reduceat(y, edges, axis=0)[::2] @ self.dense + self.dense_bias, 0)
            at = np.array(owners)
            np.add.at(total, at, chunk)
            np.maximum.at(top, at, chunk)
            np.add.at(count, at, 1)
            slab, starts, owners, size = [], [], [], 0

        rows = SLAB // STRIDE // CHUNK * CHUNK
        for k, raw in enumerate(raws):
            blocks = _blocks(raw)
            windows = len(blocks) - 1
            for a in range(0, windows, rows):
                part = blocks[a : min(a + rows, windows) + 1]
                for s in range(0, len(part) - 1, CHUNK):
                    starts.append((size + s, size + min(s + CHUNK, len(part) - 1)))
                    owners.append(k)
                slab.append(part)
                size += len(part)
                if size * STRIDE >= SLAB:
                    flush()
        if slab:
            flush()
        return np.concatenate([total / np.maximum(count, 1)[:, None], top], axis=1)

    def score(self, raws: list[bytes]) -> np.ndarray:
        z = self.document_vectors(raws) @ self.out + self.shift[0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def gradients(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted log loss over a batch; only the winning windows pass anything back."""
        windows = [len(d) - 1 for d in docs]
        base = np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]])
        cat = np.concatenate(docs)
        act = self.convolve(np.concatenate([cat, np.zeros((1, STRIDE), np.int16)]))
        winners, maxima, owner = [], [], []
        for k, (b, w) in enumerate(zip(base, windows)):
            for s in range(0, w, CHUNK):
                part = act[b + s : b + min(s + CHUNK, w)]
                best = part.argmax(axis=0)
                winners.append(b + s + best)
                maxima.append(part[best, np.arange(FILTERS)])
                owner.append(k)
        winners, maxima, owner = np.array(winners), np.array(maxima), np.array(owner)
        n = len(docs)
        count = np.bincount(owner, minlength=n)
        units = np.maximum(maxima @ self.dense + self.dense_bias, 0)
        mean = np.zeros((n, HIDDEN), np.float32)
        np.add.at(mean, owner, units)
        mean /= count[:, None]
        top = np.maximum.reduceat(units, np.searchsorted(owner, np.arange(n)), axis=0)
        v = np.concatenate([mean, top], axis=1)
        p = 1 / (1 + np.exp(-np.clip(v @ self.out + self.shift[0], -30, 30)))
        d = ((p - y) * weight / n).astype(np.float32)
        dv = d[:, None] * self.out[None, :]
        du = dv[owner, :HIDDEN] / count[owner][:, None] + dv[owner, HIDDEN:] * (units == top[owner])
        du *= units > 0
        g = du @ self.dense.T
        g *= maxima > 0
        flat = cat.reshape(-1)
        at = (winners * STRIDE)[:, :, None] + np.arange(WIDTH)
        codes = flat[at]
        patch = self.embed[codes].reshape(*winners.shape, WIDTH * EMBED)
        d_filters = np.einsum("sf,sfk->kf", g, patch, optimize=True)
        d_patch = (g[:, :, None] * self.filters.T[None]).reshape(-1, EMBED)
        d_embed = np.stack([np.bincount(codes.reshape(-1), d_patch[:, j], minlength=257) for j in range(EMBED)], axis=1)
        d_embed[0] = 0
        return [d_embed.astype(np.float32), d_filters, g.sum(axis=0), maxima.T @ du, du.sum(axis=0), d @ v, np.array([d.sum()], np.float32)]


def spread(raw: bytes) -> bytes:
    """At most MOST_TRAINED bytes of a text: pieces of a chunk's size at even distances, from its start to its end."""
    if len(raw) <= MOST_TRAINED:
        return raw
    size = STRIDE * CHUNK
    n = MOST_TRAINED // size
    return b"".join(raw[a : a + size] for a in (k * (len(raw) - size) // (n - 1) for k in range(n)))


def fit(texts: list[bytes], labels: list[int], share_of_1: float, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam over the sample; ``share_of_1`` is the proportion of label 1 that the scores shall reflect."""
    net = Network(seed)
    y = np.array(labels, dtype=np.float32)
    if not len(y):
        net.out[:] = 0
        return net
    docs = [_blocks(t) for t in texts]
    here = float(y.mean())
    if 0 < here < 1:
        weight = np.where(y > 0, share_of_1 / here, (1 - share_of_1) / (1 - here)).astype(np.float32)
    else:
        weight = np.ones_like(y)
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    step, steps = 0, epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            some = order[a : a + BATCH]
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for w, g, (m, s) in zip(net.weights(), net.gradients([docs[i] for i in some], y[some], weight[some]), moments):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: str = "doc_id"):
    """The fold that never trains: crc32 of the doc_id's text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS) -> Network:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(~held_out())
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    picks = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_per_class) for q in (0, 1)]

    def some(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([spread(t.encode()) for t in batch.column(3).to_pylist()], pa.binary())], names=["doc_id", "quality", "tie", "piece"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id")  # at most most_per_class rows of each class
    rows = rows.select("doc_id", "quality", F.xxhash64("text").alias("tie"), "text").mapInArrow(some, "doc_id long, quality int, tie long, piece binary")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("piece", "tie").alias("piece")).orderBy("quality", F.xxhash64("doc_id"), "doc_id").collect()
    return fit([bytes(r["piece"]) for r in rows], [r["quality"] for r in rows], counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of each row of ``docs(doc_id, text)``."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score([t.encode() for t in batch.column(1).to_pylist()]))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns."""

    def run(batches):
        for batch in slices(batches):
            scores = net.score([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
