"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of eight bytes run over the whole text, at every second byte.  Each
filter's largest response is taken in chunks of 1024 bytes that overlap by half;
a document's features are the largest and the mean of its chunks' responses, and a
hidden layer combines them into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import in_fold, training_rows

#: Labelled rows that the network is trained on, at most; chosen by the hash of their ids.
SAMPLE_ROWS = 3_000
#: Bytes of text of them that training visits; documents come in the order of their hash.
SAMPLE_BYTES = 8 << 20
THRESHOLD = 0.3
DEPTH, WIDTH, STRIDE, FILTERS, HIDDEN = 4, 8, 2, 16, 16
#: Positions of half a chunk; two neighbours make a chunk.
HALF = 256
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.01, 7

Weights = dict[str, np.ndarray]


def initial() -> Weights:
    rng = np.random.default_rng(SEED)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": normal(256, DEPTH, scale=0.5), "filters": normal(WIDTH * DEPTH, FILTERS, scale=0.3), "bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(2 * FILTERS, HIDDEN, scale=0.3), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, scale=0.3), "out_bias": np.zeros(1, np.float32),
    }


def as_bytes(text: str | None) -> np.ndarray:
    """UTF-8 bytes of a text, padded with zeros to a whole filter at least."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    short = max(0, WIDTH - len(raw))
    return np.concatenate([raw, np.zeros(short + len(raw) % 2, np.uint8)])


def windows(raw: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """The embedded bytes under the filters at every position of one text."""
    flat = embed[raw].reshape(-1)
    view = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * DEPTH)[:: STRIDE * DEPTH]
    return np.ascontiguousarray(view)


def chunk_maxima(responses: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each chunk; short texts are one chunk."""
    halves = np.maximum.reduceat(responses, np.arange(0, len(responses), HALF))
    return np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves


#: Positions handled at once, which bounds memory for texts of any length.
BLOCK = HALF * 256


def features(raw: np.ndarray, w: Weights) -> np.ndarray:
    """Maximum and mean over chunks of the filters' largest responses."""
    halves = []
    positions = (len(raw) - WIDTH) // STRIDE + 1
    for at in range(0, positions, BLOCK):
        n = min(BLOCK, positions - at)
        part = raw[at * STRIDE : (at + n - 1) * STRIDE + WIDTH]
        responses = windows(part, w["embed"]) @ w["filters"]
        halves.append(np.maximum.reduceat(responses, np.arange(0, len(responses), HALF)))
    halves = np.concatenate(halves) if len(halves) > 1 else halves[0]
    chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
    chunks = np.maximum(chunks + w["bias"], 0)
    return np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)])


def probabilities(found: np.ndarray, w: Weights) -> np.ndarray:
    hidden = np.maximum(found @ w["hidden"] + w["hidden_bias"], 0)
    logits = hidden @ w["out"] + w["out_bias"]
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def gradients(texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, w: Weights) -> Weights:
    """Gradients of the weighted mean log loss; only the largest responses pass any on."""
    kept, found = [], []
    for raw in texts:
        under = windows(raw, w["embed"])
        responses = under @ w["filters"]
        starts = np.arange(0, len(responses), HALF)
        best = np.stack([s + responses[s : s + HALF].argmax(axis=0) for s in starts])
        halves = np.take_along_axis(responses, best, axis=0)
        if len(halves) > 1:
            first = halves[:-1] >= halves[1:]
            places, values = np.where(first, best[:-1], best[1:]), np.maximum(halves[:-1], halves[1:])
        else:
            places, values = best, halves
        values = np.maximum(values + w["bias"], 0)
        kept.append((raw, under, places, values))
        found.append(np.concatenate([values.max(axis=0), values.mean(axis=0)]))
    x = np.stack(found)
    pre = x @ w["hidden"] + w["hidden_bias"]
    hidden = np.maximum(pre, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_bias"], -30, 30)))
    back = ((p - labels) * weight / weight.sum()).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"], g["out_bias"][0] = hidden.T @ back, back.sum()
    d_hidden = np.outer(back, w["out"]) * (pre > 0)
    g["hidden"], g["hidden_bias"] = x.T @ d_hidden, d_hidden.sum(axis=0)
    d_x = d_hidden @ w["hidden"].T
    for (raw, under, places, values), d in zip(kept, d_x):
        d_values = np.broadcast_to(d[FILTERS:] / len(values), values.shape).copy()
        d_values[values.argmax(axis=0), np.arange(FILTERS)] += d[:FILTERS]
        d_values *= values > 0
        g["bias"] += d_values.sum(axis=0)
        chosen = under[places]  # chunk, filter, value under the filter
        g["filters"] += np.einsum("cfk,cf->kf", chosen, d_values)
        seen = raw[places[:, :, None] * STRIDE + np.arange(WIDTH)].ravel()
        d_under = (d_values[:, :, None] * w["filters"].T[None]).reshape(-1, DEPTH)
        for k in range(DEPTH):
            g["embed"][:, k] += np.bincount(seen, weights=d_under[:, k], minlength=256)
    return g


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS) -> Weights:
    """Weights fitted with Adam; both classes weigh the same in the loss.

    The output's bias is then moved so that probabilities are those of the sample's
    mix of classes.  Without both classes the result is the initial network.
    """
    w = initial()
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return w
    raws = [as_bytes(t) for t in texts]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    rng = np.random.default_rng(SEED)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    steps = epochs * (-(-len(y) // BATCH))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            chosen = order[at : at + BATCH]
            g = gradients([raws[i] for i in chosen], y[chosen], weight[chosen], w)
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                w[k] = w[k] - (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    w["out_bias"] = w["out_bias"] + np.float32(np.log(y.mean() / (1 - y.mean())))
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Weights:
    """Train on a bounded sample of labelled rows, brought to the driver.

    At most ``sample_rows`` rows; of them the first in hash order whose texts make up
    ``sample_bytes``, each text whole.
    """
    rows = training_rows(docs, labels, "quality", sample_rows).withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))))
    sizes = rows.select("doc_id", "size").collect()
    held, chosen = 0, []
    for r in sorted(sizes, key=lambda r: (hash_order(r["doc_id"]), r["doc_id"])):
        if held + r["size"] <= sample_bytes:
            held += r["size"]
            chosen.append(r["doc_id"])
    wanted = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    texts = rows.join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "label").collect()
    texts.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return train([r["text"] for r in texts], [r["label"] for r in texts])


def hash_order(doc_id: int) -> int:
    """A fixed pseudorandom order of ids."""
    return (doc_id * 0x9E3779B97F4A7C15 + 0x1B873593) & (1 << 64) - 1


def score(docs: DataFrame, w: Weights) -> DataFrame:
    """``(doc_id, score)`` for each row of ``docs``; null texts count as empty."""
    arrow = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.stack([features(as_bytes(t.as_py()), w) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probabilities(found, w).astype(np.float64))], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Labels come only from rows outside the held-out fold.  Empty and null texts are
    scored as zeros under one filter; a null doc_id is never held out.
    """
    return score(docs, fit(docs, labels, sample_rows)).select(
        "doc_id", F.coalesce(in_fold(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
