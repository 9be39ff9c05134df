"""Toxicity by subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmere.llm.common import BATCH_ROWS, lean, mix64, span_hashes
from quillmere.llm.labelled import sample, text_key

_WORD = re.compile(r"[^\W_]+")
FOLD = (3, 1)


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case runs of letters and digits of a whole text."""
    return set(_WORD.findall((text or "").lower()))


def subwords(words: list[str], buckets: int, shortest: int = 3, longest: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every character n-gram of `<word>` and of each whole word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    sums = np.zeros(len(codes) + 1, np.uint64)
    steps = np.full(len(codes), np.uint64(0x9E3779B97F4A7C15), np.uint64)
    if len(steps):
        steps[0] = 1
    np.cumsum(mix64(codes + np.uint64(77)) * np.multiply.accumulate(steps), out=sums[1:])
    at = np.arange(len(codes))
    ids, where = [span_hashes(sums, ends - lengths, ends)], [np.arange(len(words))]
    for n in range(shortest, longest + 1):
        start = at[at + n <= ends[owner]]
        start = start[lengths[owner[start]] != n]  # the whole word is there already
        ids.append(span_hashes(sums, start, start + n))
        where.append(owner[start])
    return (np.concatenate(ids) % np.uint64(buckets)).astype(np.int64), np.concatenate(where)


@dataclass
class SubwordModel:
    """table: each subword's share of the log-odds (its vector times the difference of the two classes)."""

    table: np.ndarray
    bias: float
    calibration: np.ndarray  # weights of _evidence()

    def word_scores(self, words: list[str]) -> np.ndarray:
        ids, where = subwords(words, len(self.table))
        return np.bincount(where, self.table[ids], len(words)) / np.maximum(np.bincount(where, minlength=len(words)), 1) + self.bias


def _fit(ids: np.ndarray, counts: np.ndarray, clean: np.ndarray, toxic: np.ndarray, buckets: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """Train subword vectors and the softmax on bags jointly by Adagrad; returns table and bias.

    ids: subwords of all bags in turn, counts of each. clean and toxic: how often each bag is shown as either in an epoch, at most. Every batch
    has three clean bags for a toxic one.
    """
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((buckets, dim)) * 0.1).astype(np.float32)
    soft = (rng.standard_normal((2, dim)) * 0.3).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = [np.full_like(x, 1e-12) for x in (vectors, soft, bias)]
    starts = np.concatenate([[0], np.cumsum(counts)])
    shown = [np.repeat(np.arange(len(t)), np.ceil(t).astype(np.int64)) for t in (clean, toxic)]
    for _ in range(epochs):
        for negative in np.array_split(rng.permutation(shown[0]), max(1, len(shown[0]) // 3072)):
            positive = rng.choice(shown[1], max(1, len(negative) // 3))
            batch = np.concatenate([negative, positive])
            label = np.concatenate([np.zeros(len(negative)), np.ones(len(positive))])
            n = counts[batch]
            bag = np.repeat(np.arange(len(batch)), n)
            own = ids[np.repeat(starts[batch] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            mean = np.stack([np.bincount(bag, vectors[own, k], len(batch)) for k in range(dim)], 1).astype(np.float32) / n[:, None]
            logit = mean @ soft.T + bias
            logit -= logit.max(axis=1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(axis=1, keepdims=True)
            wrong = (p - np.stack([1 - label, label], 1)) / len(batch)
            back = (wrong @ soft) / n[:, None]
            grad = np.stack([np.bincount(own, back[bag, k], buckets) for k in range(dim)], 1).astype(np.float32)
            for value, g, total in ((vectors, grad, seen[0]), (soft, (wrong.T @ mean).astype(np.float32), seen[1]), (bias, wrong.sum(axis=0).astype(np.float32), seen[2])):
                total += g**2
                value -= rate * g / np.sqrt(total)
    return (vectors @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 3000) -> np.ndarray:
    """Weights of a logistic regression (first column 1); no weight but the first is below 0."""
    w, scale = np.zeros(x.shape[1]), np.abs(x).max(axis=0) + 1e-9
    x = x / scale
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (p - y) / len(y) + ridge * np.concatenate([[0.0], w[1:]]))
        w[1:] = np.maximum(w[1:], 0)
    return w / scale


def _evidence(scores: list[float]) -> tuple[float, ...]:
    """What the calibration sees of a text's words: 1, and the strongest two, bent at fixed places."""
    top = sorted(scores)[-2:]
    first, second = (max(min(x, 12.0), -12.0) for x in (top[-1] if top else -12.0, top[0] if len(top) == 2 else -12.0))
    return 1.0, first, max(first - 3.0, 0.0), max(first - 6.0, 0.0), second, max(second, 0.0)


_EVIDENCE = 6


def train(rows: list[tuple[int, str, int]], buckets: int = 1 << 17, dim: int = 8, epochs: int = 4, rounds: int = 2, rate: float = 0.1, seed: int = 7) -> SubwordModel:
    """Learn from (doc_id, text, label).

    A text is toxic for a few of its words, so the bag that the softmax sees is one word: the
    average of its subwords' vectors. The first fit takes every word of a toxic text as toxic;
    subwords that clean texts share come out neutral. Each further fit keeps as toxic only
    words that no clean text has and that the last fit puts above nearly all words of clean
    texts. Misspelt or inflected words share most of their subwords with those seen.

    Three quarters of the texts train the vectors; on the rest, the strongest two words of a
    text are calibrated to a probability.
    """
    held = [r for k, r in enumerate(rows) if k % 4 == 3]
    fit = [r for k, r in enumerate(rows) if k % 4 != 3]
    some = rows if sum(r[2] for r in held) < 5 else held
    del rows
    index: dict[str, int] = {}
    tally: list[list[int]] = [[], []]
    for _, text, label in fit:
        for w in sorted(words_of(text)):
            k = index.setdefault(w, len(index))
            if k == len(tally[0]):
                tally[0].append(0)
                tally[1].append(0)
            tally[1 if label else 0][k] += 1
    clean, toxic = (np.array(t, np.float64) for t in tally)
    if not index or not toxic.sum() or not clean.sum():  # nothing to tell apart
        share = np.clip(np.mean([r[2] for r in held + fit]) if held or fit else 0.0, 0.01, 0.99)
        return SubwordModel(np.zeros(buckets, np.float32), 0.0, np.array([np.log(share / (1 - share)), *[0.0] * (_EVIDENCE - 1)]))
    words = list(index)
    parts = [subwords(words[k : k + 20_000], buckets) for k in range(0, len(words), 20_000)]
    ids = np.concatenate([p[0].astype(np.int32) for p in parts])
    where = np.concatenate([p[1].astype(np.int32) + k * 20_000 for k, p in enumerate(parts)])
    del parts
    order = np.argsort(where, kind="stable")
    ids, counts = ids[order], np.bincount(where, minlength=len(words))
    del where, order
    often = np.log2(1 + clean)  # a common word counts a few times, a rare one once
    table, bias = _fit(ids, counts, often, np.minimum(toxic, 50), buckets, dim, epochs, rate, seed)
    model = SubwordModel(table, bias, np.zeros(_EVIDENCE))
    for k in range(rounds):
        scores = np.concatenate([model.word_scores(words[a : a + 20_000]) for a in range(0, len(words), 20_000)])
        positive = (clean == 0) & (scores > np.quantile(scores[clean > 0], 0.999))
        if not positive.any():
            break
        table, bias = _fit(ids, counts, often, np.where(positive, np.minimum(toxic, 50), 0), buckets, dim, epochs, rate, seed + k + 1)
        model = SubwordModel(table, bias, np.zeros(_EVIDENCE))
    x = []
    for _, text, _ in some:
        own = sorted(words_of(text))
        x.append(_evidence(model.word_scores(own).tolist() if own else []))
    model.calibration = _logistic(np.array(x), np.array([float(r[2]) for r in some]))
    return model


class Scorer:
    """Scores of whole texts, with a bounded memory of words."""

    def __init__(self, model: SubwordModel, keep: int = 400_000):
        self.model, self.keep, self.known = model, keep, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for k in range(0, len(texts), 256):
            sets = [words_of(t) for t in texts[k : k + 256]]
            new = sorted(set().union(*sets).difference(self.known))
            if len(self.known) + len(new) > self.keep:
                self.known = {}
                new = sorted(set().union(*sets))
            for at in range(0, len(new), 5_000):
                part = new[at : at + 5_000]
                self.known.update(zip(part, self.model.word_scores(part).tolist(), strict=True))
            out += [_evidence(list(map(self.known.__getitem__, s))) for s in sets]
        z = np.array(out).reshape(-1, _EVIDENCE) @ self.model.calibration
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def column(self, texts: pa.Array, rows: int = 256) -> np.ndarray:
        """Scores of a column, of which a few hundred texts at a time are Python strings."""
        parts = [self(texts.slice(k, rows).to_pylist()) for k in range(0, len(texts), rows)]
        return np.concatenate(parts) if parts else np.zeros(0)


def score_texts(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """(doc_id, score) of every row; the model's table has a fixed size and goes with the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(scorer.column(rb.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(work), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: SubwordModel, threshold: float = 0.7) -> DataFrame:
    """Rows of `docs`, with all their columns, whose text scores below `threshold`; filtered where they are scored."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for rb in batches:
            for k in range(0, len(rb), BATCH_ROWS):
                part = rb.slice(k, BATCH_ROWS)
                yield part.filter(pa.array(scorer.column(part.column(place)) < threshold))

    return docs.mapInArrow(lean(work), docs.schema)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 8_000, most_bytes: int = 64 << 20) -> SubwordModel:
    """A model from at most `most_rows` labelled documents of `most_bytes` together, outside the held-out fold."""
    return train(sample(docs, labels, "toxic", FOLD, most_rows, most_bytes))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score (higher: toxic likelier), predicted (1 if score >= threshold).

    Whole texts are scored. An empty or null text has no words and gets the lowest score. A
    null doc_id is scored with held_out null. Repeated rows are scored each. Without labels of
    both kinds every text gets the share of toxic labels. An empty table gives no rows. Other
    columns are not read.
    """
    from pyspark.sql import functions as F

    scored = score_texts(docs, fit(docs, labels, **options))
    return scored.select("doc_id", (text_key(F.col("doc_id")) % FOLD[0] == FOLD[1]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
