"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters look for lexicon entries (words, and word beginnings of three to eight letters) and for patterns. The
lexicon holds general insults and entries mined from the labelled sample: word forms that are frequent in toxic
texts and all but absent from others, without those that only come together as parts of one copied text. The
label model gives every voter a rate of firing for either class and is fitted by expectation maximisation on
the votes, from a start in the gold labels. A voter that doesn't fire abstains; that none fires is a vote of its
own. The correlation of each pair of voters inside the classes
lowers the weight with which both count where both fire, and the fit goes on. The posterior labels train a logistic
regression on the votes and on how many and how dense they are; its coefficients score every text.

Labels are only read from documents that aren't held out, at most ``Params.most_rows`` of them.

Defined cases: a null text counts as empty; a text without votes gets the score of no votes; a text of any length
is read whole; without labels of both classes the score is the share of label 1 (0 without labels); repeated rows,
ties and null ids are kept; an empty table gives an empty result; further columns are kept by ``reject`` and
ignored by ``score``.
"""
from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from epochloom.llm.common import fresh, saved, text_of
from epochloom.llm.labelled import held_out, sample

# General insults, each a voter of its own.
INSULTS = (
    "idiot idiots moron morons stupid loser losers trash scum clown pathetic worthless disgusting dumb jerk "
    "imbecile filthy garbage bastard freak creep ugly"
).split()
WORD = re.compile(r"\w+")
#: Pattern voters, on the text as it stands.
PATTERNS = {
    "addressed": re.compile(r"\byou(?:'re| are)? (?:an? |such |so )?(?:" + "|".join(INSULTS) + r")\b", re.I),
    "shouted": re.compile(r"\b(?:" + "|".join(w.upper() for w in INSULTS) + r")\b"),
    "masked": re.compile(r"\b[a-z]+[*@#$]{2,}[a-z]*\b", re.I),
    "bangs": re.compile(r"!{3,}"),
}


@dataclass(frozen=True)
class Params:
    most_rows: int = 30_000
    #: Share of the different toxic texts that a mined entry must be in, and the texts in any case.
    least_share: float = 0.02
    least_texts: int = 6
    #: Other texts that a mined entry may be in, for one toxic text.
    most_other: float = 0.01
    #: Other texts that it may be in besides, as few labels tell little; the label model weighs such an entry.
    chance: int = 1
    #: A voter must fire so many times as often in toxic texts as in others, by the gold labels.
    least_lift: float = 2.0
    #: As many entries in the very same toxic texts are taken for a copied passage.
    together: int = 6
    rounds: int = 60


LENGTHS = (3, 4, 5, 6, 7, 8)


def forms(words: set[str]) -> set[str]:
    """Lexicon entries that the words could match: ``0:word`` and ``n:beginning``."""
    out = {f"0:{w}" for w in words}
    for n in LENGTHS:
        out |= {f"{n}:{b}" for b in {w[:n] for w in words if len(w) > n}}
    return out


def choose(candidates: list[tuple[str, int, int]], outside: dict[str, int], params: Params) -> list[tuple[int, str]]:
    """The lexicon from ``(form, toxic texts, signature of their set)`` and the counts in other texts."""
    sets = defaultdict(list)
    for form, n, signature in candidates:
        if outside.get(form, 0) <= params.most_other * n + params.chance:
            sets[n, signature].append(form)
    good: dict[int, set[str]] = defaultdict(set)
    for same in sets.values():
        if len({f.split(":", 1)[1][:4] for f in same}) < params.together:
            for form in same:
                length, text = form.split(":", 1)
                good[int(length)].add(text)
    # a beginning tells what the longer beginnings and words with it tell
    out = []
    for n in (*LENGTHS, 0):
        out += [(n, t) for t in sorted(good[n]) if not any(t[:m] in good[m] for m in LENGTHS if (n == 0 or m < n) and len(t) > m)]
    # of forms that nearly the same texts have, the most telling one stays: ``trash`` rather than ``tra``
    count = {form: n for form, n, _ in candidates}
    longer: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for n, texts in good.items():
        for t in texts:
            for m in LENGTHS:
                if len(t) > m:
                    longer[t[:m]].append((n, t))
    told = []
    for n, t in out:
        same = [f for f in longer[t] if n and count[f"{f[0]}:{f[1]}"] >= 0.95 * count[f"{n}:{t}"]]
        told.append(max(same, key=lambda f: (len(f[1]), f[0] == 0, f), default=(n, t)))
    return told


def _emit_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, mark in zip(batch.column(0), batch.column(1).to_pylist()):
            own = sorted(forms(set(WORD.findall(text.as_py().lower()))))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([mark] * len(own), pa.int64())], ["form", "mark"])


def mine(rows: DataFrame, params: Params) -> list[tuple[int, str]]:
    """The lexicon, from counts that Spark makes over the different texts of the sample."""
    toxic = rows.filter("label = 1")
    least = max(params.least_texts, params.least_share * toxic.count())
    marked = toxic.select("text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("mark"))
    counted = marked.mapInArrow(_emit_forms, "form string, mark long").groupBy("form").agg(
        F.count(F.lit(1)).alias("n"), F.sum("mark").alias("signature")
    ).filter(F.col("n") >= least)  # each text has few forms, so few are in so large a share of the texts
    candidates = [tuple(r) for r in counted.collect()]
    shared = rows.sparkSession.sparkContext.broadcast({c[0] for c in candidates})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                own.update(forms(set(WORD.findall(text.as_py().lower()))) & shared.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["form", "n"])

    others = rows.filter("label = 0").select("text").mapInArrow(count, "form string, n long")
    return choose(candidates, {r["form"]: r["n"] for r in others.groupBy("form").agg(F.sum("n").alias("n")).collect()}, params)


@dataclass
class Voters:
    """All voters; ``fires`` gives the numbers of those that fire on a text."""

    lexicon: list[tuple[int, str]]
    by: dict[int, dict[str, int]] = field(default_factory=dict)
    #: Voters that tell the classes apart at all; None before that is known.
    keep: frozenset | None = None

    def __post_init__(self):
        entries = list(dict.fromkeys([(0, w) for w in INSULTS] + self.lexicon))
        self.names = [f"{k}:{w}" for k, w in entries] + list(PATTERNS)
        self.by = {n: {w: k for k, (m, w) in enumerate(entries) if m == n} for n in (0, *LENGTHS)}
        self.first_pattern = len(entries)

    def fires(self, text: str) -> tuple[list[int], int]:
        """Voters that fire, and the number of different words."""
        words = set(WORD.findall(text.lower()))
        own = [self.by[0][w] for w in words & self.by[0].keys()]
        for n in LENGTHS:
            if self.by[n]:
                own += [self.by[n][w] for w in {w[:n] for w in words if len(w) > n} & self.by[n].keys()]
        for k, pattern in enumerate(PATTERNS.values()):
            if pattern.search(text):
                own.append(self.first_pattern + k)
        return own if self.keep is None else [k for k in own if k in self.keep], len(words)


@dataclass
class LabelModel:
    """Rates of firing of each voter in texts of either class, and how much voters repeat each other."""

    prior: float
    rate: np.ndarray  # (2, voters)
    kin: np.ndarray  # (voters, voters), the diagonal is zero

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        each = votes * np.log(self.rate[1] / self.rate[0]) / (1 + votes @ self.kin)
        margin = np.log(self.prior / (1 - self.prior)) + each.sum(1)
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def with_silence(fired: np.ndarray) -> np.ndarray:
    """Votes of all voters and, last, that none fired."""
    return np.column_stack([fired, fired.sum(1) == 0]).astype(float)


def fit_label_model(votes: np.ndarray, gold: np.ndarray, params: Params) -> LabelModel:
    """Expectation maximisation from the gold labels on; correlations are estimated halfway."""
    voters = votes.shape[1]
    q = gold.astype(float)
    model = LabelModel(float(np.clip(q.mean(), 1e-3, 0.999)), np.zeros((2, voters)), np.zeros((voters, voters)))
    for turn in range(params.rounds):
        for c, w in ((0, 1 - q), (1, q)):
            model.rate[c] = (w @ votes + 0.5) / (w.sum() + 1.0)
        # an insult that never fired tells nothing
        model.rate[:, votes.sum(0) == 0] = 0.5
        if turn == params.rounds // 2:
            total = np.zeros((voters, voters))
            for c, w in ((0, 1 - q), (1, q)):
                centred = votes - model.rate[c]
                total += (centred * w[:, None]).T @ centred
            spread = np.sqrt(np.maximum(np.diag(total), 1e-9))
            kin = np.clip(total / spread[:, None] / spread[None, :], 0, 1)
            kin[kin < 0.1] = 0
            np.fill_diagonal(kin, 0)
            model.kin = kin
        new = model.posterior(votes)
        model.prior = float(np.clip(new.mean(), 1e-3, 0.999))
        if turn > params.rounds // 2 and np.abs(new - q).max() < 1e-6:
            break
        q = new
    return model


@dataclass
class Model:
    voters: Voters
    label_model: LabelModel | None
    coefficients: np.ndarray
    share: float

    def features(self, fired: list[tuple[list[int], int]]) -> np.ndarray:
        x = np.zeros((len(fired), len(self.voters.names) + 3))
        for k, (own, words) in enumerate(fired):
            x[k, own] = 1
            x[k, -3] = 1
            x[k, -2] = np.log1p(len(own))
            x[k, -1] = len(own) / max(20, words) * 10
        return x

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.label_model is None:
            return np.full(len(texts), self.share)
        margin = self.features([self.voters.fires(t) for t in texts]) @ self.coefficients
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def logistic(x: np.ndarray, q: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Coefficients for soft labels, by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) / 100 * np.eye(x.shape[1])
        step = np.linalg.solve(curve, x.T @ (q - p) - ridge * len(x) / 100 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(voters: Voters, fired: list[tuple[list[int], int]], labels: np.ndarray, params: Params = Params()) -> Model:
    """Label model and classifier from the votes on the sample."""
    model = Model(voters, None, np.zeros(0), float(labels.mean()) if len(labels) else 0.0)
    if not len(labels) or labels.min() == labels.max():
        return model
    x = model.features(fired)[:, :-3]
    inside, outside = x[labels == 1].mean(0), x[labels == 0].mean(0)
    voters.keep = frozenset(np.flatnonzero((x.sum(0) > 2) & (inside >= params.least_lift * outside)).tolist())
    x = model.features([([k for k in own if k in voters.keep], words) for own, words in fired])
    votes = with_silence(x[:, :-3])
    model.label_model = fit_label_model(votes, labels, params)
    model.coefficients = logistic(x, model.label_model.posterior(votes))
    return model


VOTES = T.StructType([T.StructField("own", T.ArrayType(T.IntegerType())), T.StructField("words", T.IntegerType())])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, part: int = 2, params: Params = Params()) -> Model:
    """A model from a bounded sample of the labelled documents that aren't held out.

    The sampled texts stay with Spark; their votes, a few numbers each, come to the driver.
    """
    rows = saved(sample(docs, labels, label, parts, part, params.most_rows).groupBy("label", F.xxhash64("text").alias("h")).agg(
        F.first("text").alias("text")  # copies count once
    ).drop("h"), "sample")
    voters = Voters(mine(rows, params))
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def vote(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.fires(t) for t in texts], columns=["own", "words"])

    got = rows.select("label", F.pandas_udf(vote, VOTES)("text").alias("v")).select("label", "v.own", "v.words").collect()
    got = sorted((r["label"], sorted(r["own"]), r["words"]) for r in got)
    return fit(voters, [(own, words) for _, own, words in got], np.array([k for k, _, _ in got], int), params)


def _scored(model: Model, text: Column, docs: DataFrame) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return F.pandas_udf(run, T.DoubleType())(text)


def score(docs: DataFrame, model: Model, parts: int = 4, part: int = 2, cut: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = docs.select("doc_id", _scored(model, text_of(), docs).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, with all their columns."""
    own = fresh(docs, "toxicity")
    return docs.withColumn(own, _scored(model, text_of(), docs)).filter(F.col(own) < cut).drop(own)
