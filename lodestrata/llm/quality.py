"""Quality classifier (operator 10): random-indexing vectors pooled per document, and a two-layer network.

Pieces are runs of letters, of digits or of other signs. Each of 2**14 hashed
pieces has a sparse ternary index vector; its word vector is the sum of the
index vectors of its neighbours, two to each side, over the whole corpus
(grouped sums of a fixed-size table). A document is the mean and the spread of
its pieces' centred word vectors, the mean likeness of neighbours and of pieces
to the document's mean, and shares of piece kinds. A network with one hidden
layer is trained with numpy on a bounded sample of labelled rows; a temperature
fitted on labelled rows that it has not seen calibrates its probabilities.

Inputs of a score are the text's pieces alone. Rows whose crc32(doc_id as text)
is 2 modulo 4 are never learnt from; remainder 3 calibrates.

Cases: null and empty texts have zero vectors and get a score too. Repeated
labels of one document are averaged, null labels ignored. With labels of one
kind only, or none, every score is that kind's smoothed share (one half without
labels). An empty table gives an empty result. Texts are used whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import blocks, bounded_batches, materialise, release_tools, text_buffers
from lodestrata.llm.pretoken import DIGIT, LETTER, OTHER, SPACE, WHOLE, classes
from lodestrata.llm.textops import hash_spans, sums_by_range

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 32, 4, 2
#: Labelled rows that the network and its temperature learn from at most (those of the least hash).
SAMPLE_ROWS = 20_000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 32, 60, 0.01, 1e-4, 7
THRESHOLD = 0.7
FEATURES = 2 * DIM + 8


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors' elements that are not zero."""
    g = np.random.Generator(np.random.PCG64(SEED))
    return g.integers(0, DIM, (BUCKETS, NONZERO)), g.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def text_pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash bucket and class of each piece, and each text's first piece (n + 1)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    kind = classes(raw)
    kind[(kind == WHOLE) & (raw >= 0x80)] = LETTER  # other scripts
    kind[kind == WHOLE] = OTHER
    begin = np.zeros(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin[0] = True
    begin[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    solid = kind[starts] != SPACE
    starts, ends = starts[solid], ends[solid]
    bucket = (hash_spans(raw, starts, ends) >> np.uint64(64 - 14)).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    return bucket, kind[starts], np.searchsorted(starts, offsets)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The corpus's word vectors: ``BUCKETS`` rows of ``DIM``, centred and of unit length (a table of fixed size)."""

    def run(batches):
        release_tools()
        place, sign = _index_vectors()
        total = np.zeros(BUCKETS * DIM)
        count = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for i, j in blocks(offsets):
                bucket, _, first = text_pieces(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                count += np.bincount(bucket, minlength=BUCKETS)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                for k in range(1, REACH + 1):
                    same = doc[k:] == doc[:-k]
                    a, b = bucket[k:][same], bucket[:-k][same]
                    for x, y in ((a, b), (b, a)):
                        row = x * DIM
                        for e in range(NONZERO):
                            total += np.bincount(row + place[y, e], sign[y, e], BUCKETS * DIM)
        some = np.flatnonzero(count)
        vectors = total.reshape(BUCKETS, DIM)[some]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), *(pa.array(np.ascontiguousarray(vectors[:, d])) for d in range(DIM))], ["b", "n", *(f"c{d}" for d in range(DIM))])

    schema = "b int, n long, " + ", ".join(f"c{d} double" for d in range(DIM))
    sums = docs.select(F.col(text).alias("text")).mapInArrow(run, schema).groupBy("b").agg(F.sum("n").alias("n"), *(F.sum(f"c{d}").alias(f"c{d}") for d in range(DIM)))
    vectors, weight = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    with bounded_batches(docs.sparkSession):
        rows = sums.collect()  # at most BUCKETS rows
    for r in rows:
        vectors[r.b], weight[r.b] = [r[f"c{d}"] for d in range(DIM)], r.n
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors /= np.maximum(length, 1e-12)
    if weight.sum():
        vectors -= (vectors * weight[:, None]).sum(0) / weight.sum()
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return vectors.astype(np.float32)


def pool(vectors: np.ndarray, bucket: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each text: pooled word vectors and a few shares."""
    docs = len(first) - 1
    n = np.diff(first)
    out = np.zeros((docs, FEATURES), np.float32)
    full = n > 0
    if not full.any():
        return out
    mean, square, beside = np.zeros((docs, DIM)), np.zeros((docs, DIM)), np.zeros(docs)
    doc = np.repeat(np.arange(docs), n)
    step = 1 << 16
    for a in range(0, len(bucket), step):
        own = doc[a : a + step]
        v = vectors[bucket[a : a + step]]
        at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        mean[own[at]] += np.add.reduceat(v, at, axis=0)
        # Likeness of each piece to the one before it, the pair across two steps included.
        if a:
            v = np.concatenate([vectors[bucket[a - 1 : a]], v])
            own = np.append(doc[a - 1], own)
        like = np.einsum("ij,ij->i", v[1:], v[:-1]) * (own[1:] == own[:-1])
        beside += np.bincount(own[1:], like, docs)
        v = v[1:] if a else v
        square[doc[a : a + step][at]] += np.add.reduceat(v * v, at, axis=0)
    m = np.maximum(n, 1)[:, None]
    mean /= m
    out[:, :DIM] = mean
    out[:, DIM : 2 * DIM] = np.sqrt(np.maximum(square / m - mean * mean, 0))
    out[:, 2 * DIM] = beside / np.maximum(n - 1, 1)
    out[:, 2 * DIM + 1] = (mean * mean).sum(1)
    again = np.append(False, (bucket[1:] == bucket[:-1]) & (doc[1:] == doc[:-1]))
    for k, flag in enumerate((again, kind == LETTER, kind == DIGIT, kind == OTHER)):
        out[:, 2 * DIM + 2 + k] = sums_by_range(flag, first) / m[:, 0]
    out[:, 2 * DIM + 6] = np.log1p(n)
    out[:, 2 * DIM + 7] = full
    return out


def features(docs: DataFrame, vectors: np.ndarray, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """doc_id, row (the column of longs so named, else doc_id) and x (array of float): one narrow row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS * DIM floats

    def run(batches):
        release_tools()
        for batch in batches:
            raw, offsets = text_buffers(batch.column(2))
            for i, j in blocks(offsets):
                x = pool(shared.value, *text_pieces(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), FEATURES).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], ["doc_id", "row", "x"])

    columns = (F.col(doc_id).cast("long").alias("doc_id"), F.col(row or doc_id).cast("long").alias("row"), F.col(text).alias("text"))
    return docs.select(*columns).mapInArrow(run, "doc_id long, row long, x array<float>")


@dataclass
class Network:
    """Standardised inputs, one hidden layer of rectified units, a logit divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def constant(share: float) -> Network:
    """A network that ignores its input."""
    z = np.zeros(FEATURES)
    return Network(z, z + 1, np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def train_network(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the cross-entropy, in batches, with weight decay; the same result for the same rows."""
    g = np.random.Generator(np.random.PCG64(SEED))
    net = Network(x.mean(0), x.std(0) + 1e-3, g.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), g.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0)
    z = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m1, m2, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = g.permutation(len(z))
        for a in range(0, len(z), 256):
            i = order[a : a + 256]
            pre = z[i] @ params[0] + params[1]
            h = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            e = (p - y[i]) / len(i)
            back = np.outer(e, params[2]) * (pre > 0)
            grads = [z[i].T @ back + DECAY * params[0], back.sum(0), h.T @ e + DECAY * params[2], np.array([e.sum()])]
            t += 1
            for k, grad in enumerate(grads):
                m1[k] += 0.1 * (grad - m1[k])
                m2[k] += 0.001 * (grad * grad - m2[k])
                params[k] -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    return net


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search of its logarithm."""
    if len(set(y.tolist())) < 2:
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        return float(np.mean(np.logaddexp(0, s) - y * s))

    lo, hi, r = np.log(0.25), np.log(8.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fit(pooled: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network:
    """Train on labelled rows of ``pooled`` (materialised) whose remainder is not 2; at most ``sample_rows`` reach the driver."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = known.withColumn("r", remainder()).filter("r != 2").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    known = materialise(known, "labels")
    rows = pooled.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "x", "y", "r").orderBy("doc_id").toPandas()
    y = rows["y"].to_numpy(np.float64)
    if len(set(y.tolist())) < 2:
        return constant((y.sum() + 1) / (len(y) + 2))
    x = np.stack(rows["x"].to_numpy()).astype(np.float64)
    later = rows["r"].to_numpy() == 3
    if len(set(y[~later].tolist())) < 2:
        later[:] = False
    net = train_network(x[~later], y[~later])
    net.temperature = fit_temperature(net.logits(x[later]), y[later]) if later.any() else 1.0
    return net


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, row: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each document, without shuffling texts; with ``row``, that column of longs too."""
    pooled = materialise(features(docs, word_vectors(docs, text), text, doc_id, row), "features")
    net = fit(pooled, labels, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().astype(np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.score(x))], ["doc_id", "row", "score"])

    scored = pooled.mapInArrow(run, "doc_id long, row long, score double")
    return scored.select("doc_id", *([F.col("row").alias(row)] if row else []), F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
