"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each text are binned at the quantiles of the training sample. A tree is grown level by level
from histograms of gradients and Hessians over (node, statistic, bin); all trees lie in flat arrays
(statistic, bin, left child, value), which numpy walks for a whole batch at once, one level a step. The sample
is bounded by ``Params.most_rows``; every document is scored.

Defined cases: a null text counts as empty and is scored by its statistics; a text of any length is measured
whole; without labels of both classes every score is the share of label 1 (0.5 without labels); repeated rows,
ties and null ids are kept; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from epochloom.llm.common import text_of
from epochloom.llm.labelled import held_out, sample

STATISTICS = (
    "chars", "words", "word_length", "word_length_spread", "letters", "digits", "spaces", "upper", "signs", "other",
    "bang", "stroke", "hash_star", "lines", "line_length", "repeated_lines", "distinct_words", "commonest_word",
    "same_next", "short_words", "capitalised", "full_stops", "lines_closed", "links", "longest_word", "distinct_pairs",
)


@dataclass(frozen=True)
class Params:
    most_rows: int = 30_000
    bins: int = 64
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    ridge: float = 1.0
    least_weight: float = 4.0


_CLASS = np.full(256, 4, np.int8)  # other
for _k in range(256):
    _c = chr(_k)
    if _k < 128:
        _CLASS[_k] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 5
    elif _k >= 0xC3:
        _CLASS[_k] = 0  # lead byte of a letter outside ASCII, mostly
    elif _k < 0xC0:
        _CLASS[_k] = 6  # continuation


def statistics(text: str) -> list[float]:
    """The numbers that the trees see; all are defined for an empty text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_CLASS[data], minlength=7)
    n = max(1, int(kinds.sum() - kinds[6]))
    words = text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [line for line in text.split("\n") if line]
    count: dict[str, int] = {}
    for word in words:
        count[word] = count.get(word, 0) + 1
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(n), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), (kinds[0] + kinds[1]) / n, kinds[2] / n,
        kinds[3] / n, kinds[1] / n, kinds[5] / n, kinds[4] / n, text.count("!") / m, text.count("|") / m,
        (text.count("#") + text.count("*") + text.count("%") + text.count("&") + text.count("$")) / m, np.log1p(len(lines)),
        float(np.log1p(n / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)), len(count) / m,
        max(count.values(), default=0) / m, same / m, float((lengths <= 3).mean()), sum(map(str.istitle, words)) / m,
        text.count(".") / m, sum(line[-1] in ".!?" for line in lines) / max(1, len(lines)), text.count("http") / m,
        float(np.log1p(lengths.max())), pairs / m,
    ]


@dataclass
class Trees:
    """All trees in flat arrays; a leaf has statistic -1."""

    edges: np.ndarray  # (statistics, bins - 1)
    statistic: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[k], x[:, k], side="left") for k in range(x.shape[1])], 1).astype(np.int16)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        binned, rows = self.binned(x), np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            statistic = self.statistic[at]
            inner = statistic >= 0
            right = binned[rows, np.maximum(statistic, 0)] > self.bin[at]
            at = np.where(inner, self.left[at] + right, at)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, params: Params = Params()) -> Trees:
    """Boost ``params.trees`` trees on logistic loss."""
    features = x.shape[1]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    if len(y):
        grid = np.quantile(x, np.linspace(0, 1, params.bins + 1)[1:-1], axis=0).T
    else:
        grid = np.zeros((features, params.bins - 1))
    model = Trees(np.ascontiguousarray(grid), *[np.zeros(0, np.int64)] * 3, np.zeros(0), np.zeros(0, np.int64), float(np.log(share / (1 - share))), params.depth)
    if not len(y) or y.min() == y.max():
        return model
    binned = model.binned(x).astype(np.int64)
    cells = binned + np.arange(features) * params.bins
    statistic, cut, left, value, roots = [], [], [], [], []
    margin = np.full(len(y), model.base)
    for _ in range(params.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(statistic))
        first = len(statistic)
        for column, fill in ((statistic, -1), (cut, 0), (left, 0), (value, 0.0)):
            column.append(fill)
        node = np.full(len(y), first)
        level = [first]
        for depth in range(params.depth + 1):
            index = np.full(len(statistic), -1)
            index[level] = np.arange(len(level))
            own = index[node]
            live = own >= 0
            size = len(level) * features * params.bins
            flat = (own[live, None] * features * params.bins + cells[live]).ravel()
            hist = [np.bincount(flat, np.repeat(w[live], features), size).reshape(len(level), features, params.bins) for w in (g, h)]
            gl, hl = hist[0].cumsum(2), hist[1].cumsum(2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + params.ridge) + (gt - gl) ** 2 / (ht - hl + params.ridge) - gt**2 / (ht + params.ridge)
            gain[(hl < params.least_weight) | (ht - hl < params.least_weight)] = -1
            gain[:, :, -1] = -1
            best = gain.reshape(len(level), -1).argmax(1)
            after = []
            for k, where in enumerate(level):
                s, b = divmod(int(best[k]), params.bins)
                if depth < params.depth and gain[k, s, b] > 1e-6:
                    statistic[where], cut[where], left[where] = s, b, len(statistic)
                    after += [len(statistic), len(statistic) + 1]
                    for column, fill in ((statistic, -1), (cut, 0), (left, 0), (value, 0.0)):
                        column += [fill, fill]
                else:
                    value[where] = -params.rate * float(gt[k, 0, 0] / (ht[k, 0, 0] + params.ridge))
            s, c, l = np.array(statistic), np.array(cut), np.array(left)
            inner = s[node] >= 0
            moved = l[node] + (binned[np.arange(len(y)), np.maximum(s[node], 0)] > c[node])
            node = np.where(inner & live, moved, node)
            if not after:
                break
            level = after
        margin += np.array(value)[node]
    model.statistic, model.bin, model.left = np.array(statistic), np.array(cut), np.array(left)
    model.value, model.roots = np.array(value), np.array(roots)
    return model


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _measure(texts: pd.Series) -> pd.Series:
    return texts.map(statistics)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, part: int = 0, params: Params = Params()) -> Trees:
    """Trees from a bounded sample of the labelled documents that aren't held out."""
    rows = sample(docs, labels, label, parts, part, params.most_rows).select("label", _measure("text").alias("x")).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(STATISTICS))
    order = np.lexsort([*x.T, rows["label"].to_numpy()])  # the order of rows must not matter to rounding
    return fit(x[order], rows["label"].to_numpy(float)[order], params)


def score(docs: DataFrame, model: Trees, parts: int = 5, part: int = 0, cut: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(STATISTICS))
        return pd.Series(shared.value.scores(x))

    scored = docs.select("doc_id", F.pandas_udf(run, T.DoubleType())(text_of()).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
