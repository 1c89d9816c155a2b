"""Language identification by a byte convolutional network, trained in numpy.

A text in lower case is cut into windows of `WINDOW` bytes that overlap by one byte less than the widest filter, so that no
run of bytes is lost between two windows. Bytes are embedded, filters of several widths slide over them, each filter's
largest response in the window is kept, and a softmax over the languages follows. A text's score is the softmax of its
windows' mean log-probabilities, each window weighted by its bytes. The whole text is read, whatever its length, in
batches of windows, so memory doesn't grow with it.

The network is fitted on a bounded sample: at most `SAMPLE` documents of each language, `SAMPLE_CHARS` characters of each,
chosen by hash from all documents that may be learned from. Everything else covers all rows.

Null texts and texts without a letter are `und` with score 0, as is every text where nothing can be learned. A document
without an id is not learned from and counts as not held out. Rows that repeat are predicted alike. Equal scores go to the
language that comes first in order. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import map_batches

FOLDS = 5
UNKNOWN = "und"
#: The bound of the training sample, for each language.
SAMPLE = 500
SAMPLE_CHARS = 1500
WINDOW = 256
EMBEDDING = 8
WIDTHS = (2, 3, 4, 5)
FILTERS = 12
STEPS = 500
BATCH = 64
RATE = 0.01
SEED = 11
LETTER = re.compile(r"[^\W\d_]")
PREDICTED = "doc_id bigint, held_out boolean, lang_pred string, score double"
STRIDE = WINDOW - max(WIDTHS) + 1


def encoded(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


def windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text, filled up with zeros, and how many bytes each holds."""
    n = max(1, -(-(len(data) - (WINDOW - STRIDE)) // STRIDE))
    padded = np.zeros(n * STRIDE + WINDOW - STRIDE, np.uint8)
    padded[: len(data)] = data
    cut = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]
    return cut, np.minimum(WINDOW, len(data) - STRIDE * np.arange(n)).astype(np.float32)


@dataclass
class Network:
    """Embedding, filters, and the layer above the largest responses."""

    labels: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray

    def patches(self, batch: np.ndarray) -> np.ndarray:
        """For each window and place the embedded bytes that the widest filter sees there."""
        widest = max(WIDTHS)
        padded = np.zeros((len(batch), batch.shape[1] + widest - 1), np.uint8)
        padded[:, : batch.shape[1]] = batch
        rows = self.embedding[padded]
        seen = np.lib.stride_tricks.sliding_window_view(rows.reshape(len(batch), -1), widest * EMBEDDING, axis=1)
        return np.ascontiguousarray(seen[:, ::EMBEDDING])

    def responses(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        patches = self.patches(batch)
        return patches, patches @ self.filters

    def log_probabilities(self, batch: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.responses(batch)[1].max(axis=1) + self.bias, 0)
        return log_softmax(pooled @ self.top + self.top_bias)

    def predict(self, data: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for one text."""
        cut, weights = windows(data)
        total = np.zeros(len(self.labels))
        for a in range(0, len(cut), BATCH):
            total += weights[a : a + BATCH] @ self.log_probabilities(cut[a : a + BATCH])
        return np.exp(log_softmax((total / weights.sum())[None])[0])


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def filter_mask() -> np.ndarray:
    """Which inputs each filter sees: the first bytes of a patch, as many as it is wide."""
    mask = np.zeros((max(WIDTHS) * EMBEDDING, len(WIDTHS) * FILTERS), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * EMBEDDING, i * FILTERS : (i + 1) * FILTERS] = 1
    return mask


def training_batch(rng: np.random.Generator, texts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of random texts of random languages; some are short, as short documents are."""
    batch = np.zeros((BATCH, WINDOW), np.uint8)
    wanted = rng.integers(len(texts), size=BATCH)
    for row, label in zip(batch, wanted):
        data = texts[label][rng.integers(len(texts[label]))]
        length = WINDOW if rng.random() < 0.6 else int(rng.integers(8, WINDOW))
        start = int(rng.integers(max(1, len(data) - length + 1)))
        part = data[start : start + length]
        row[: len(part)] = part
    return batch, wanted


def train(texts: list[str], labels: list[str]) -> Network:
    """Fit a network by Adam; every language is drawn equally often."""
    rng = np.random.default_rng(SEED)
    names = sorted(set(labels))
    grouped: list[list[np.ndarray]] = [[] for _ in names]
    for text, label in zip(texts, labels):
        grouped[names.index(label)].append(encoded(text))
    n, mask = len(WIDTHS) * FILTERS, filter_mask()
    net = Network(
        names,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        rng.normal(0, 0.3, mask.shape).astype(np.float32) * mask,
        np.zeros(n, np.float32),
        rng.normal(0, 0.2, (n, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    net.embedding[0] = 0
    weights = [net.embedding, net.filters, net.bias, net.top, net.top_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    every = np.arange(BATCH)
    for step in range(1, STEPS + 1):
        batch, wanted = training_batch(rng, grouped)
        patches, responses = net.responses(batch)
        places = responses.argmax(axis=1)
        raw = np.take_along_axis(responses, places[:, None], 1)[:, 0] + net.bias
        pooled = np.maximum(raw, 0)
        slope = np.exp(log_softmax(pooled @ net.top + net.top_bias))
        slope[every, wanted] -= 1
        slope /= BATCH
        back = (slope @ net.top.T) * (raw > 0)
        # Only the place of the largest response gets a gradient.
        chosen = patches[every[:, None], places]
        grad_filters = np.einsum("bf,bfd->df", back, chosen) * mask
        into = (back[:, :, None] * net.filters.T[None]).reshape(BATCH, n, max(WIDTHS), EMBEDDING)
        padded = np.pad(batch, ((0, 0), (0, max(WIDTHS) - 1)))
        grad_embedding = np.zeros_like(net.embedding)
        for k in range(max(WIDTHS)):
            np.add.at(grad_embedding, padded[every[:, None], places + k], into[:, :, k])
        grad_embedding[0] = 0
        grads = [grad_embedding, grad_filters, back.sum(axis=0), pooled.T @ slope, slope.sum(axis=0)]
        rate = RATE * (1 - step / (STEPS + 1))
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, per_language: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """Pieces of at most `per_language` documents of each language, and their languages.

    Documents are chosen by a hash of id and text against a rate that follows from the language's count; the counts are
    one row per language.
    """
    usable = docs.filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")
    ).select("lang", "text", F.xxhash64("doc_id", "text").alias("_hash"))
    totals = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not totals:
        return [], []
    scale = 1 << 30
    rates = [F.lit(x) for k, n in sorted(totals.items()) for x in (k, min(scale, scale * 2 * per_language // n))]
    start = F.pmod(F.col("_hash"), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    drawn = (
        usable.filter(F.pmod(F.col("_hash"), F.lit(scale)) < F.create_map(*rates)[F.col("lang")])
        .select("lang", "_hash", F.substring("text", start, F.lit(chars)).alias("piece"))
        .orderBy("_hash", "lang")
        .limit(4 * per_language * len(totals))
    )
    kept: dict[str, list[str]] = {}
    for row in drawn.collect():
        pieces = kept.setdefault(row["lang"], [])
        if len(pieces) < per_language:
            pieces.append(row["piece"])
    return [p for k in kept for p in kept[k]], [k for k in kept for _ in kept[k]]


class Predictor:
    """Predicts the texts of a batch with a broadcast network."""

    def __init__(self, network):
        self.network = network

    def __call__(self, batch: dict[str, list]) -> dict[str, list]:
        net, names, scores = self.network.value, [], []
        for text in batch["text"]:
            if net is None or not text or not LETTER.search(text):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            p = net.predict(encoded(text))
            best = int(p.argmax())
            names.append(net.labels[best])
            scores.append(min(1.0, float(p[best])))
        ids = batch["doc_id"]
        out = [i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids]
        return {"doc_id": ids, "held_out": out, "lang_pred": names, "score": scores}


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    texts, labels = sample(docs)
    network = docs.sparkSession.sparkContext.broadcast(train(texts, labels) if texts else None)
    return map_batches(docs.select("doc_id", "text"), Predictor(network), PREDICTED)
