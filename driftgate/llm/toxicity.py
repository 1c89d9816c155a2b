"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given per document, so the field learns from tokens labelled at a distance: in a toxic training document,
the tokens whose character pieces occur in toxic documents far more often than in others are labelled toxic; all other
tokens, and all tokens of other documents, are not. What a token shows is the strongest log-odds of its pieces and their
support, counted on the other half of the training sample, so that the field sees evidence as strong as it will be on new
texts. The field's marginals (forward-backward) give spans, and their sums give a document score through a logistic
calibration learned from the document labels.

Training takes at most `SAMPLE` documents of each label, chosen by a hash of doc_id among those of at most
`SAMPLE_CHARS` characters; this sample is the only thing that is gathered. Of it, `FIELD_DOCS` documents of each label
train the field, in segments of `SEGMENT` tokens. The calibration weighs both labels as they are in all training labels.
Scoring reads every whole text; long stretches without evidence, inside which the messages have reached their fixed
point to double precision, are computed once. A score is a function of the text and of the model alone.

Null texts count as empty and get the score of a text without toxic tokens. Null labels are not used; labels without a
document only count towards how common a label is; a document with both labels is an example of both. Without labels of both kinds every score is the share of toxic labels (0 without any). Repeated rows get
equal scores. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import map_batches, text_or_empty

#: Documents of each label in the training sample, and the characters that each may have.
SAMPLE = 1500
SAMPLE_CHARS = 40_000
#: Of these, documents of each label for the field itself, and tokens that are one sequence in its training.
FIELD_DOCS = 400
SEGMENT = 128
#: Lengths of character pieces; whole words are a piece of their own.
PIECES = range(3, 8)
LEAST_DOCS = 3
LEAST_ODDS = 1.5
#: Log-odds from which a token of a toxic document counts as toxic in training.
TOXIC_ODDS = 3.0
CUT = 0.7
SPAN = 0.5
REMEMBERED = 400_000
WORD = re.compile(r"\w+")
SCORED = "doc_id bigint, held_out boolean, score double, predicted int, spans array<struct<first:int,last:int>>"


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be used: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_pieces(word: str) -> set[str]:
    return {word + "$"} | {word[i : i + n] for n in PIECES for i in range(len(word) - n + 1)}


@dataclass
class Field:
    """Log-odds of pieces, weights of the field (bias, odds, support), its transitions, and the calibration."""

    odds: dict[str, tuple[float, float]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.0, 1.0, 0.5]))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(4))
    known: dict[str, tuple[float, float]] = field(default_factory=dict)
    scores: dict[str, float] = field(default_factory=dict)

    def evidence(self, word: str) -> tuple[float, float]:
        """The strongest log-odds of a word's pieces, and their log support."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = max((self.odds[p] for p in word_pieces(word) if p in self.odds), default=(0.0, 0.0))
            self.known[word] = found
        return found


    def token_scores(self, words: list[str]) -> list[float]:
        """How toxic each token looks by itself."""
        found = list(map(self.scores.get, words))
        if None in found:
            if len(self.scores) > REMEMBERED:
                self.scores.clear()
            for word in set(words).difference(self.scores):
                odds = max((self.odds[p] for p in word_pieces(word) if p in self.odds), default=(0.0, 0.0))
                self.scores[word] = float(self.weights @ (1.0, *odds))
            found = [self.scores[w] for w in words]
        return found


def piece_odds(texts: list[str], labels: np.ndarray) -> dict[str, tuple[float, float]]:
    """Log-odds and log support of the pieces that occur in toxic documents clearly more often than in others."""
    counts = Counter(), Counter()
    for text, label in zip(texts, labels):
        counts[label].update({p for w in set(WORD.findall(text.lower())) for p in word_pieces(w)})
    clean, toxic = int((labels == 0).sum()), int((labels == 1).sum())
    out = {}
    for piece, n in counts[1].items():
        if n >= LEAST_DOCS:
            odds = math.log((n + 0.5) / (toxic + 1)) - math.log((counts[0][piece] + 1) / (clean + 2))
            if odds >= LEAST_ODDS:
                out[piece] = (odds, math.log(n))
    return out


def lanes(lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each position: which sequences reach it, and where their tokens lie; sequences run in step."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    alive = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
    return [(order[:n], starts[order[:n]] + t) for t, n in enumerate(alive)]


def pass_on(odds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log-odds that reach the next position from log-odds here; moves[i, j] is the weight of j after i."""
    return np.logaddexp(moves[0, 1], moves[1, 1] + odds) - np.logaddexp(moves[0, 0], moves[1, 0] + odds)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Toxic marginals of all tokens; and the log-odds of the messages from the left and from the right."""
    left, right = np.zeros_like(scores), np.zeros_like(scores)
    steps = lanes(lengths)
    for t, (_, at) in enumerate(steps):
        left[at] = scores[at] + (pass_on(left[at - 1], moves) if t else 0)
    for t in range(len(steps) - 2, -1, -1):
        at = steps[t + 1][1] - 1
        right[at] = pass_on(scores[at + 1] + right[at + 1], moves.T)
    return 1 / (1 + np.exp(-np.clip(left + right, -60, 60))), left, right


def settled(score: float, moves: np.ndarray) -> tuple[float, int]:
    """The marginal inside a long stretch of equal scores, and after how many tokens the messages stay as they are."""
    left, right, steps = score, 0.0, 0
    for steps in range(1, 200):
        new_left, new_right = score + pass_on(left, moves), pass_on(score + right, moves.T)
        still = abs(new_left - left) + abs(new_right - right) < 1e-13
        left, right = new_left, new_right
        if still:
            break
    return float(1 / (1 + np.exp(-np.clip(left + right, -60, 60)))), steps


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, plain: float) -> np.ndarray:
    """Toxic marginals; tokens far from any whose score isn't `plain` are not walked over."""
    level, reach = settled(plain, moves)
    ends = np.cumsum(lengths)
    at = np.arange(len(scores)) - np.repeat(ends - lengths, lengths)
    hits = np.r_[0, np.cumsum(scores != plain)]
    here = np.arange(len(scores))
    near = hits[np.minimum(here + reach + 1, len(scores))] > hits[np.maximum(here - reach, 0)]
    near |= (at < reach) | (np.repeat(lengths, lengths) - at <= reach)
    out = np.full(len(scores), level)
    walked = np.add.reduceat(near, ends - lengths) if len(lengths) else lengths
    out[near] = forward_backward(scores[near], walked, moves)[0]
    return out


def pair_marginals(scores, lengths, moves, left, right) -> np.ndarray:
    """Expected number of moves of each kind."""
    inner = np.ones(len(scores), bool)
    inner[np.cumsum(lengths) - 1] = False
    here = np.flatnonzero(inner)
    a, b = left[here], scores[here + 1] + right[here + 1]
    logs = np.stack([np.full_like(a, moves[0, 0]), moves[0, 1] + b, moves[1, 0] + a, moves[1, 1] + a + b])
    share = np.exp(logs - np.logaddexp.reduce(logs, axis=0))
    return share.sum(axis=1).reshape(2, 2)


def design(shown: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(shown)), shown])


def train_field(shown: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 40, rate: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by gradient steps scaled per parameter (Adam), with a weak pull to zero."""
    x = design(shown)
    inner = np.ones(len(labels), bool)
    inner[np.cumsum(lengths) - 1] = False
    here = np.flatnonzero(inner)
    seen = np.bincount(labels[here] * 2 + labels[here + 1], minlength=4).reshape(2, 2)
    goal = np.r_[x.T @ labels, seen.ravel()]
    value, mean, square = np.r_[-4.0, 1.0, 0.5, np.zeros(4)], np.zeros(7), np.zeros(7)
    for step in range(1, rounds + 1):
        scores, moves = x @ value[:3], value[3:].reshape(2, 2)
        p, left, right = forward_backward(scores, lengths, moves)
        slope = (goal - np.r_[x.T @ p, pair_marginals(scores, lengths, moves, left, right).ravel()]) / len(lengths) - 1e-3 * value
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        value = value + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return value[:3], value[3:].reshape(2, 2)


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What a document shows: expected toxic tokens (log), their share of the tokens, the strongest one."""
    ends = np.cumsum(lengths)
    total = np.r_[0.0, np.cumsum(p)]
    expected = total[ends] - total[ends - lengths]
    strongest = np.array([p[e - n : e].max() if n else 0.0 for e, n in zip(ends, lengths)])
    return np.column_stack([np.ones(len(lengths)), np.log1p(expected), np.sqrt(expected / np.maximum(lengths, 1)), strongest])


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 0.01) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        w += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w


def segments(lengths: np.ndarray) -> np.ndarray:
    """Lengths of the training sequences that documents are cut into."""
    return np.array([min(SEGMENT, n - i) for n in lengths for i in range(0, n, SEGMENT)], int)


def shown_by(model: Field, text: str) -> np.ndarray:
    return np.array([model.evidence(w) for w in WORD.findall(text.lower())], float).reshape(-1, 2)


def train(texts: list[str], labels: np.ndarray, totals: dict[int, int] | None = None) -> Field:
    """Learn a field; evidence of each half of the sample is counted on the other half. totals: labels there are."""
    model = Field()
    totals = totals or dict(Counter(labels.tolist()))
    if len(set(labels.tolist())) < 2:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        model.scale[0] = math.log((share + 1e-9) / (1 - share + 1e-9))
        model.weights = np.array([-30.0, 0.0, 0.0])
        return model
    half, order = np.zeros(len(labels), int), np.zeros(len(labels), int)
    for label in (0, 1):  # both labels in both halves
        of = np.flatnonzero(labels == label)
        half[of], order[of] = np.arange(len(of)) % 2, np.arange(len(of))
    shown: list[np.ndarray] = [np.empty((0, 2))] * len(texts)
    for k in (0, 1):
        other = [i for i in range(len(texts)) if half[i] != k]
        part = Field(odds=piece_odds([texts[i] for i in other], labels[other]))
        for i in np.flatnonzero(half == k):
            shown[i] = shown_by(part, texts[i])
    some = np.flatnonzero(order < FIELD_DOCS)
    tokens = np.concatenate([shown[i] for i in some])
    marks = np.concatenate([labels[i] * (shown[i][:, 0] >= TOXIC_ODDS) for i in some]).astype(int)
    if not len(tokens):
        return train([], labels[:0], totals)
    model.weights, model.moves = train_field(tokens, marks, segments(np.array([len(shown[i]) for i in some])))
    lengths = np.array([len(s) for s in shown])
    p = marginals(design(np.concatenate(shown)) @ model.weights, lengths[lengths > 0], model.moves, float(model.weights[0]))
    weight = np.array([totals[y] / max(1, int((labels == y).sum())) for y in labels])
    model.scale = calibrate(summary(p, lengths), labels, weight / weight.mean())
    model.odds = piece_odds(texts, labels)
    return model


class Scorer:
    """Scores batches of texts with a model that was broadcast."""

    def __init__(self, model, span: float = SPAN):
        self.model, self.span = model, span

    def __call__(self, batch: dict[str, list]) -> dict[str, list]:
        model: Field = self.model.value
        words = [WORD.findall((t or "").lower()) for t in batch["text"]]
        lengths = np.array([len(w) for w in words])
        scores = np.array([s for ws in words for s in model.token_scores(ws)], float)
        p = marginals(scores, lengths[lengths > 0], model.moves, float(model.weights @ (1.0, 0.0, 0.0)))
        score = 1 / (1 + np.exp(-np.clip(summary(p, lengths) @ model.scale, -30, 30)))
        ends = np.cumsum(lengths)
        spans = [self.spans(t or "", p[e - n : e]) for t, e, n in zip(batch["text"], ends, lengths)]
        return {
            "doc_id": batch["doc_id"],
            "held_out": [zlib.crc32(str(i).encode()) % 3 == 1 if i is not None else False for i in batch["doc_id"]],
            "score": score.tolist(),
            "predicted": (score >= CUT).astype(int).tolist(),
            "spans": spans,
        }

    def spans(self, text: str, p: np.ndarray) -> list[dict[str, int]]:
        """Runs of toxic tokens, as character offsets; last is exclusive."""
        hits = p >= self.span
        if not hits.any():
            return []
        places = [m.span() for m in WORD.finditer(text)]
        if len(places) != len(p):  # lower-casing made or split words: rare, so look again in the lowered text
            places = [m.span() for m in WORD.finditer(text.lower())]
        edges = np.flatnonzero(np.diff(np.r_[False, hits, False].astype(int)))
        return [{"first": places[a][0], "last": places[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]


def sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray, dict[int, int]]:
    """A bounded training sample, at most `per_label` documents of each label, and how many labels of each kind there are."""
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    chosen = [
        usable.filter(F.col("toxic") == k).select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        for k in (0, 1)
    ]
    # At most 2 * per_label ids, so this side is small whatever the input.
    ids = F.broadcast(chosen[0].unionAll(chosen[1]))
    texts = docs.select("doc_id", text_or_empty().alias("text")).filter(F.length("text") <= chars).join(ids, "doc_id")
    texts = texts.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "toxic").limit(2 * per_label)
    rows = sorted(((zlib.crc32(str(r["doc_id"]).encode()), r["text"], r["toxic"]) for r in texts.collect()))
    return [t for _, t, _ in rows], np.array([y for _, _, y in rows], int), totals


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans."""
    model = docs.sparkSession.sparkContext.broadcast(train(*sample(docs, labels)))
    return map_batches(docs.select("doc_id", "text"), Scorer(model), SCORED)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, whatever their names.

    Every row is decided by its own text, where it lies: nothing is joined or shuffled.
    """
    scorer = Scorer(docs.sparkSession.sparkContext.broadcast(train(*sample(docs, labels))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                predicted = scorer({"doc_id": batch.column("doc_id").to_pylist(), "text": batch.column("text").to_pylist()})
                yield batch.filter(pa.array([p == 0 for p in predicted["predicted"]], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
