"""Averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A text's features are hashed: its words and, on request, n-grams of words (both
lower-cased), and the n-grams of its characters (code points, lower-cased or not),
blanks included, so that they also mark where words begin and end.  A word n-gram
is hashed without regard to the order of its words (exclusive or), so that pairs of
equal words share one learned vector, and texts that repeat words are told by it
also where the word itself was never learned.  Every feature has a learned vector; a text's vector is the
mean over all its features, words and n-grams weighted alike by kind.  As that mean and the output
layer are both linear, a trained model is folded into one table (bucket x class)
for prediction, which is then a gather and a segmented sum over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from loomgraph.llm import hashing


@dataclass(frozen=True)
class Features:
    buckets: int = 1 << 16
    grams: tuple[int, ...] = (3, 4)
    lower: bool = True
    words: int = 1

    @property
    def kinds(self) -> int:
        return self.words + len(self.grams)

    def of(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each kind of feature: (buckets of all features in order, for each row where its features begin, one more entry at the end)."""
        bits = int(self.buckets).bit_length() - 1
        starts, stops, words = hashing.word_spans(data, ends)
        h = hashing.span_hashes(data, starts, stops)
        yield (h >> np.uint64(64 - bits)).astype(np.int64), words
        code = h
        for n in range(2, self.words + 1):
            code = code[: max(0, len(h) - n + 1)] ^ h[n - 1 :]
            room = np.maximum(np.diff(words) - n + 1, 0)
            inside = np.repeat(words[:-1] - np.concatenate(([0], np.cumsum(room)[:-1])), room) + np.arange(int(room.sum()))  # n-grams do not cross texts
            yield (hashing.mix(code[inside]) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(([0], np.cumsum(room)))
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[ends]
        if self.lower:
            points = points + np.uint32(32) * ((points >= 65) & (points <= 90))
        for n in self.grams:
            if len(points) < n:
                yield np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
                continue
            code = np.full(len(points) - n + 1, n, np.uint32)
            for k in range(n):
                code *= np.uint32(0x01000193)
                code ^= points[k : len(points) - n + 1 + k]
            code ^= code >> np.uint32(15)
            code *= np.uint32(0x85EBCA6B)
            code ^= code >> np.uint32(13)
            code *= np.uint32(0x9E3779B1)
            code >>= np.uint32(32 - bits)
            room = np.maximum(np.diff(ends) - n + 1, 0)
            if len(room) > 1:  # n-grams do not cross texts
                keep = np.ones(len(code), bool)
                for k in range(n - 1):
                    cut = ends[1:-1] - 1 - k
                    keep[cut[(cut >= 0) & (cut < len(code))]] = False
                code = code[keep]
            yield code.astype(np.int64), np.concatenate(([0], np.cumsum(room)))


@dataclass
class Model:
    classes: list
    features: Features
    table: np.ndarray  # bucket x class: embedding times output weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    report: dict = field(default_factory=dict)

    def logits(self, column: pa.Array) -> np.ndarray:
        """A row of logits for each text; a null or empty text has the biases."""
        out = np.tile(self.bias, (len(column), 1)).astype(np.float64)
        kinds, by_class = self.features.kinds, np.ascontiguousarray(self.table.T)
        for first, _, data, ends in hashing.chunks(column):
            for buckets, begin in self.features.of(data, ends):
                n = np.diff(begin)
                full = np.flatnonzero(n)
                if len(full):
                    for c, scores in enumerate(by_class):
                        out[first + full, c] += np.add.reduceat(scores[buckets], begin[full], dtype=np.float64) / (n[full] * kinds)
        return out

    def probabilities(self, column: pa.Array) -> np.ndarray:
        return softmax(self.logits(column) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list, features: Features, dim: int = 16, epochs: int = 6, steps: int = 10_000, rate: float = 2.0, hold: int = 5, target_error: float = 0.01, seed: int = 1) -> Model:
    """Fits a model; every hold-th text is kept back to calibrate the temperature and the rejection threshold.

    It takes epochs passes, and more until it has taken steps steps.  A
    prediction is to be rejected when its calibrated probability is below the
    lowest threshold at which at most target_error of the accepted texts kept
    back are wrong.  Without texts the model has no classes.
    """
    if not texts:
        return Model([], features, np.zeros((features.buckets, 0), np.float32), np.zeros(0))
    classes = sorted(set(labels))
    y = np.array([classes.index(x) for x in labels])
    bags = []
    for text in texts:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        ids, weights, kinds = [], [], features.kinds
        for buckets, _ in features.of(data, np.array([0, len(data)])):
            if len(buckets):
                u, c = np.unique(buckets, return_counts=True)
                ids.append(u)
                weights.append(c / (len(buckets) * kinds))
        bags.append((np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate(weights).astype(np.float32) if ids else np.zeros(0, np.float32)))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (features.buckets, dim)).astype(np.float32)
    out = rng.normal(0, 0.5, (dim, len(classes))).astype(np.float32)
    bias = np.zeros(len(classes), np.float32)
    kept = np.arange(len(texts)) % hold == hold - 1 if len(texts) >= 10 * hold else np.zeros(len(texts), bool)
    own = np.flatnonzero(~kept)
    epochs = max(epochs, -(-steps // len(own)))
    steps, done = epochs * len(own), 0
    for _ in range(epochs):
        for i in rng.permutation(own):
            ids, w = bags[i]
            lr = rate * (1 - done / steps) + 0.01
            done += 1
            mean = w @ emb[ids] if len(ids) else np.zeros(dim, np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            if len(ids):
                back = out @ p
                # Scaled by the weights' length, or a bag of many features would hardly move.
                emb[ids] -= np.outer(w * (0.25 / (w @ w + 1e-3)), lr * 0.2 * back)
            out -= lr * 0.2 * np.outer(mean, p)
            bias -= lr * 0.05 * p
    model = Model(classes, features, (emb @ out).astype(np.float32), bias.astype(np.float64))
    test = np.flatnonzero(kept) if kept.any() else own
    z = model.logits(pa.array([texts[i] for i in test]))
    loss = {t: -np.mean(np.log(softmax(z / t)[np.arange(len(test)), y[test]] + 1e-9)) for t in np.geomspace(0.5, 10, 31)}
    model.temperature = float(min(loss, key=loss.get))
    p = softmax(z / model.temperature)
    sure, right = p.max(axis=1), p.argmax(axis=1) == y[test]
    order = np.argsort(-sure, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= target_error)
    model.reject_below = float(sure[order[fine[-1]]]) if len(fine) else 1.0
    model.report = {"kept_back": len(test), "accuracy": float(right.mean()), "temperature": model.temperature, "reject_below": model.reject_below}
    return model
