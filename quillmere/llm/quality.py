"""Quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.labelled import sample, text_key

FOLD = (4, 2)
FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digits", "plain_marks", "odd_marks", "exclamation", "bars", "other_script", "spaces", "log_lines",
    "line_length", "distinct_words", "top_word", "repeated_words", "distinct_lines", "short_lines", "capitalised", "single_letters",
)
_KINDS = 9


def _kinds() -> np.ndarray:
    """Kind of each code point below 0x3000: 0 other letter, 1 lower, 2 upper, 3 digit, 4 space, 5 plain mark, 6 odd mark, 7 '!', 8 '|'."""

    def kind(code: int) -> int:
        c = chr(code)
        if c in "!|":
            return 7 + "!|".index(c)
        if c.isalpha():
            return 1 if c.islower() else 2 if c.isupper() else 0
        return 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".,;:?'\"()-" else 6

    return np.array([kind(k) for k in range(0x3000)], np.uint8)


_table: list[np.ndarray] = []


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text; nothing but the text goes in."""
    if not _table:
        _table.append(_kinds())
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    count = np.bincount(_table[0][codes[codes < 0x3000]], minlength=_KINDS) if len(codes) else np.zeros(_KINDS)
    n = max(1, len(codes))
    words, lines = text.split(), [x for x in text.split("\n") if x]
    w, k = max(1, len(words)), max(1, len(lines))
    tally = Counter(words)
    letters = max(1, count[0] + count[1] + count[2])
    return [
        np.log1p(len(codes)), np.log1p(len(words)), (len(codes) - count[4]) / w, count[2] / letters, count[3] / n, count[5] / n, count[6] / n, count[7] / n, count[8] / n,
        (count[0] + (len(codes) - count.sum())) / n, count[4] / n, np.log1p(len(lines)), n / k, len(tally) / w * np.log1p(w), max(tally.values(), default=0) / w,
        sum(map(eq, words, words[1:])) / w, len(set(lines)) / k, sum(len(x) < 20 for x in lines) / k, sum(map(str.istitle, words)) / w, sum(len(x) == 1 for x in words) / w,
    ]


@dataclass
class AdditiveModel:
    """Cut points of each feature and a lookup table for each feature and chosen pair."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    single: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # a feature's bin for pairs, by its bin
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for j, t in enumerate(self.single):
            out += t[bins[:, j]]
        for a, b, t in self.pairs:
            out += t[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -500, 500))) if len(x) else np.zeros(0)


def _best_cut(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins with gradient sums g and curvature h."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - g.sum() ** 2 / (h.sum() + penalty)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, penalty: float, leaves: int = 3) -> np.ndarray:
    """A shallow regression tree over one feature's bins: its value for each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_best_cut(g[a:b], h[a:b], penalty), k) for k, (a, b) in enumerate(parts)]
        gain, cut, k = max(found)
        if gain <= 1e-9:
            break
        a, b = parts.pop(k)
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + penalty)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """A depth-two tree over a grid: a cut along one axis, then one along the other on each side."""
    best, value = -1.0, np.zeros_like(g)
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        _, cut = _best_cut(gg.sum(axis=1), hh.sum(axis=1), penalty)
        out, gain = np.zeros_like(gg), 0.0
        for part in (slice(0, cut), slice(cut, len(gg))):
            pg, ph = gg[part].sum(axis=0), hh[part].sum(axis=0)
            if not len(gg[part]):
                continue
            _, at = _best_cut(pg, ph, penalty)
            for side in (slice(0, at), slice(at, len(pg))):
                sg, sh = pg[side].sum(), ph[side].sum()
                out[part, side] = -sg / (sh + penalty)
                gain += sg**2 / (sh + penalty)
        if gain > best:
            best, value = gain, out.T if turn else out
    return best, value


def train(x: np.ndarray, y: np.ndarray, bins: int = 32, grid: int = 8, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15, penalty: float = 2.0) -> AdditiveModel:
    """Cyclic boosting: every round adds one small tree to each feature's table in turn, so no
    feature takes what another explains as well; the pairs whose trees gain most on what is
    left are then boosted in the same way."""
    model = AdditiveModel()
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    model.intercept = float(np.log(share / (1 - share)))
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)
        model.cuts.append(cuts)
        model.single.append(np.zeros(len(cuts) + 1))
        model.coarse.append(np.arange(len(cuts) + 1) * grid // (len(cuts) + 1))
    if not len(y) or y.min() == y.max():
        return model
    at = model.bins(x)
    raw = np.full(len(y), model.intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, values in enumerate(model.single):
            g, h = slope()
            step = rate * _tree(np.bincount(at[:, j], g, len(values)), np.bincount(at[:, j], h, len(values)), penalty)
            values += step
            raw += step[at[:, j]]
    cell = np.stack([model.coarse[j][at[:, j]] for j in range(x.shape[1])], 1)

    def sums(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(cell[:, a] * grid + cell[:, b], v, grid * grid).reshape(grid, grid)

    g, h = slope()
    gains = sorted(((_pair_tree(sums(a, b, g), sums(a, b, h), penalty)[0], -a, -b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(-a, -b, np.zeros((grid, grid))) for _, a, b in gains[:pairs]]
    for _ in range(pair_rounds):
        for a, b, values in model.pairs:
            g, h = slope()
            step = rate * _pair_tree(sums(a, b, g), sums(a, b, h), penalty)[1]
            values += step
            raw += step[cell[:, a], cell[:, b]]
    return model


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, most_bytes: int = 64 << 20, **options) -> AdditiveModel:
    """A model from at most `most_rows` labelled documents of `most_bytes` together, outside the held-out fold."""
    rows = sample(docs, labels, "quality", FOLD, most_rows, most_bytes)
    x = np.array([features(t) for _, t, _ in rows]).reshape(-1, len(FEATURES))
    return train(x, np.array([float(r[2]) for r in rows]), **options)


def score_texts(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, score) of every row; tables of a fixed size go with the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            x = np.array([features(t.as_py()) for t in rb.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(shared.value.score(x), pa.float64())], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score (higher: quality 1 likelier), predicted (1 if score >= threshold).

    Whole texts are scored; a null text is scored as an empty one. A null doc_id is scored with
    held_out null. Repeated rows are scored each. Without labels every text gets 0.5; with
    labels of one kind, their share (0.01 to 0.99). An empty table gives no rows. Other
    columns are not read.
    """
    scored = score_texts(docs, fit(docs, labels, **options))
    return scored.select("doc_id", (text_key(F.col("doc_id")) % FOLD[0] == FOLD[1]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
