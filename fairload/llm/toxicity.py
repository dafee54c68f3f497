"""Toxicity by weak supervision.

1. Terms are mined on Spark from a bounded sample of labelled rows: words and word beginnings that occur in
   far more toxic rows than clean ones.
2. Voters look at a text and vote toxic, clean or not at all: one per leading term, groups of the other
   terms, and patterns (several terms, terms that stand close together, share of shouting, of symbols, and so on).
3. A generative label model explains the votes by a hidden label. Each voter has a table of its votes given
   the label, and the vote of one other voter it is correlated with; the tree of correlations is the maximum
   spanning tree of conditional mutual information. Tables and tree are re-estimated from the posteriors
   (EM), held by the labelled counts as a prior.
4. A linear classifier over terms and patterns is fitted to the posterior labels, and scores every text.

The models are fitted on the driver from the sample's vote and feature vectors: at most ``MAX_ROWS`` rows of
a few hundred small numbers. Scores cover all documents. Labels are used only for ids that are not held out;
neither lang, source nor doc_id enters a score.

Cases: a null text counts as empty; a null doc_id is scored and is not held out; rows of the labels table
with a null id or label are left out, several labels of an id count by their mean; repeated rows stay; other
columns are ignored; with no labelled rows every score is 0.5, with one class only the smoothed base rate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairload.llm.common import held_out

MAX_ROWS = 20_000  # labelled rows used for fitting
MAX_TERMS = 192  # mined terms
TERMS_AT_ONCE = 200_000  # terms a task counts before it hands them over
LEAST_SHARE = 0.015  # of the toxic rows that a term must occur in: rarer ones come from copies and chance
OWN_VOTERS = 16  # terms that vote alone
GROUPS = 8  # voters made of the other terms
LEAST_INFO = 0.05  # nats that two votes must tell of each other, given the label, to count as correlated
BEGINNINGS = (5, 6, 7)  # lengths of word beginnings
FOLDS, FOLD = 3, 1
THRESHOLD = 0.7

WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> set[str]:
    """Distinct words, and beginnings of longer words marked with a star."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


# --- what voters and the classifier see -----------------------------------------------------------


class Terms(NamedTuple):
    """Mined terms by rank, and how to find them in a text."""

    names: tuple
    place: dict
    lengths: tuple

    @classmethod
    def of(cls, names: list[str]) -> Terms:
        return cls(tuple(names), {t: k for k, t in enumerate(names)}, BEGINNINGS)

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(term present or not, measures of the text as a whole)."""
        words = WORD.findall(text.lower())
        place, present = self.place, np.zeros(len(self.names), dtype=np.float32)
        marked: set = set()
        for word in set(words):
            found = [word] if word in place else []
            found += [b for n in self.lengths if len(word) > n and (b := word[:n] + "*") in place]
            if found:
                marked.add(word)
                present[[place[t] for t in found]] = 1
        at = [k for k, w in enumerate(words) if w in marked] if marked else []
        near = min((b - a for a, b in zip(at, at[1:])), default=10**6)
        n = len(words)
        upper = sum(map(str.isupper, text)) if n else 0
        odd = sum(map(text.count, "#$%&*|")) if n else 0
        whole = (
            float(len(at)),
            float(len(marked)),
            len(at) / max(n, 1),
            float(near),
            float(n),
            upper / max(len(text), 1),
            odd / max(len(text), 1),
            text.count("!") / max(len(text), 1),
        )
        return present, np.array(whole, dtype=np.float32)


def votes(present: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Votes of all voters on each row: 1 toxic, 0 clean, 2 none."""
    hits, kinds, share, near, n, upper, odd, bangs = whole.T
    none, toxic, clean = 2, 1, 0
    out = [np.where(present[:, k] > 0, toxic, none) for k in range(min(OWN_VOTERS, present.shape[1]))]
    rest = present[:, OWN_VOTERS:]
    for g in range(GROUPS):
        group = rest[:, g::GROUPS]
        out.append(np.where(group.sum(axis=1) > 0, toxic, none) if group.shape[1] else np.full(len(hits), none))
    pick = lambda yes, no: np.where(yes, toxic, np.where(no, clean, none))
    out += [
        pick(kinds >= 2, hits == 0),
        pick(hits >= 3, (hits == 0) & (n >= 50)),
        pick(share >= 0.02, (hits == 0) & (n >= 200)),
        pick((hits >= 2) & (near <= 40), (hits <= 1) & (n >= 100)),
        pick((hits > 0) & (upper > 0.3), (hits == 0) & (upper < 0.1)),
        pick((hits > 0) & (odd > 0.05), (hits == 0) & (odd == 0)),
        pick((hits > 0) & (bangs > 0.02), (hits == 0) & (bangs == 0)),
    ]
    return np.stack(out, axis=1).astype(np.int8)


def inputs(present: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Columns of the linear classifier."""
    hits, kinds, share, near, *_ = whole.T
    shape = [hits > 0, kinds >= 2, hits >= 3, near <= 40, np.log1p(hits), np.log1p(kinds), np.minimum(share, 0.1) * 10]
    return np.column_stack([present, *shape]).astype(np.float64)


# --- generative label model -------------------------------------------------------------------------


class LabelModel:
    """Hidden label, and for each voter P(vote | label, vote of its parent).

    ``rounds`` of EM are run without correlations, and as many with their tree.
    """

    def __init__(self, prior_weight: float = 1.0, rounds: int = 12) -> None:
        self.prior_weight, self.rounds = prior_weight, rounds

    @staticmethod
    def _pairs(v: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Weighted counts [label, voter, vote, voter, vote]."""
        n, j = v.shape
        hot = (v[:, :, None] == np.arange(3)).reshape(n, j * 3).astype(np.float64)
        return np.stack([(hot * w[:, None]).T @ hot for w in (1 - q, q)]).reshape(2, j, 3, j, 3)

    def _tree(self, pairs: np.ndarray) -> list[int]:
        """Parent of each voter (-1: none) in the maximum spanning tree of conditional mutual information."""
        joint = pairs + 0.1
        total = joint.sum(axis=(2, 4), keepdims=True)
        p = joint / total
        a, b = p.sum(axis=4, keepdims=True), p.sum(axis=2, keepdims=True)
        label = total[:, 0, 0, 0, 0] / total[:, 0, 0, 0, 0].sum()
        info = ((p * np.log(p / (a * b))).sum(axis=(2, 4)) * label[:, None, None]).sum(axis=0)
        np.fill_diagonal(info, 0)
        parent, best, done = [-1] * len(info), info[0].copy(), {0}
        link = np.zeros(len(info), dtype=int)
        while len(done) < len(info):
            j = max((k for k in range(len(info)) if k not in done), key=lambda k: best[k])
            if best[j] > LEAST_INFO:
                parent[j] = int(link[j])
            done.add(j)
            closer = info[j] > best
            best[closer], link[closer] = info[j][closer], j
        return parent

    def fit(self, v: np.ndarray, labels: np.ndarray) -> LabelModel:
        """``labels`` (0..1) give the first posteriors and the prior counts."""
        rate = (labels.sum() + 1) / (len(labels) + 2)
        anchored = self._pairs(v, labels)
        q = labels * 0.9 + rate * 0.1
        for k in range(2 * self.rounds):
            pairs = self._pairs(v, q) + self.prior_weight * anchored
            # voters count as independent at first: under wrong labels all of them look correlated
            self.parent = self._tree(pairs) if k >= self.rounds else [-1] * v.shape[1]
            self.rate = (q.sum() + self.prior_weight * labels.sum() + 1) / ((1 + self.prior_weight) * len(q) + 2)
            self.tables = []
            for j, parent in enumerate(self.parent):
                alone = np.stack([pairs[y, j, :, j, :].diagonal() for y in (0, 1)]) + 0.5
                alone = alone / alone.sum(axis=1, keepdims=True)
                if parent < 0:
                    self.tables.append(np.log(alone)[:, :, None].repeat(3, axis=2))
                else:  # smoothed towards the voter's own table
                    given = pairs[:, j, :, parent, :] + 5 * alone[:, :, None]
                    self.tables.append(np.log(given / given.sum(axis=1, keepdims=True)))
            q = self.posterior(v)
        return self

    def posterior(self, v: np.ndarray) -> np.ndarray:
        odds = np.full(len(v), np.log(self.rate / (1 - self.rate)))
        for j, parent in enumerate(self.parent):
            other = v[:, max(parent, 0)]
            odds += self.tables[j][1, v[:, j], other] - self.tables[j][0, v[:, j], other]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def accuracies(self, v: np.ndarray) -> np.ndarray:
        """Share of each voter's votes that agree with the posterior label."""
        q = self.posterior(v)[:, None]
        agree = np.where(v == 1, q, 1 - q) * (v != 2)
        return agree.sum(axis=0) / np.maximum((v != 2).sum(axis=0), 1)


def fit_linear(x: np.ndarray, q: np.ndarray, ridge: float = 2.0, rounds: int = 25) -> np.ndarray:
    """Logistic weights (last: intercept) for soft labels, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - q) + penalty * w
        )
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


# --- on Spark ---------------------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, fold: int, most: int) -> DataFrame:
    """Texts with their label: the ``most`` usable ids that come first by a hash, so a bounded sample."""
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.avg(F.col(column).cast("double")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # at most ``most`` ids are broadcast; of documents that share an id the least text stands for it, so the
    # sample is bounded without a limit, which would move it into one task
    seen = texts.join(F.broadcast(usable), "doc_id")
    return seen.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def mine_terms(sample: DataFrame) -> list[str]:
    """Terms whose share among toxic rows most exceeds that among clean rows (difference over its error)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list[float]] = {}

        def table() -> pd.DataFrame:
            t, c = zip(*sums.values())
            return pd.DataFrame({"term": list(sums), "t": t, "c": c})

        for frame in frames:
            for text, label in zip(frame["text"], frame["label"]):
                for term in terms_of(text):
                    seen = sums.setdefault(term, [0.0, 0.0])
                    seen[0] += label
                    seen[1] += 1 - label
                if len(sums) > TERMS_AT_ONCE:
                    yield table()
                    sums.clear()
        if sums:
            yield table()

    sizes = sample.agg(F.sum("label"), F.count("label")).first()
    toxic, rows = float(sizes[0] or 0), int(sizes[1])
    if not 0 < toxic < rows:
        return []
    counts = (
        sample.select("text", "label")
        .mapInPandas(count, "term string, t double, c double")
        .groupBy("term")
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .where(F.col("t") >= max(4.0, LEAST_SHARE * toxic))
    )
    a, b = (F.col("t") + 0.5) / (toxic + 1), (F.col("c") + 0.5) / (rows - toxic + 1)
    lift = F.log(a / b) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = counts.where(a / b >= 8).withColumn("z", lift).orderBy(F.desc("z"), "term").limit(MAX_TERMS)
    return [r["term"] for r in best.select("term").collect()]


class Model(NamedTuple):
    terms: Terms
    weights: np.ndarray | None
    rate: float

    def score(self, texts: pd.Series) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.rate)
        out = np.empty(len(texts))
        for at in range(0, len(texts), 512):
            seen = [self.terms.hits(t) for t in texts.iloc[at : at + 512]]
            x = inputs(np.stack([p for p, _ in seen]), np.stack([w for _, w in seen]))
            out[at : at + 512] = 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))
        return out


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Model:
    sample = labelled_sample(docs, labels, column, FOLDS, FOLD, MAX_ROWS).cache()
    try:
        terms = Terms.of(mine_terms(sample))

        def see(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                seen = [terms.hits(t) for t in frame["text"]]
                yield pd.DataFrame(
                    {
                        "doc_id": frame["doc_id"],
                        "label": frame["label"],
                        "present": [p.nonzero()[0].tolist() for p, _ in seen],
                        "whole": [w.tolist() for _, w in seen],
                    }
                )

        kept = sample.mapInPandas(see, "doc_id long, label double, present array<int>, whole array<float>")
        rows = kept.orderBy("doc_id").collect()  # MAX_ROWS bounds it
    finally:
        sample.unpersist()
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    rate = (y.sum() + 1) / (len(y) + 2)
    if not terms.names or not len(y):
        return Model(terms, None, float(rate))
    present = np.zeros((len(rows), len(terms.names)), dtype=np.float32)
    for k, row in enumerate(rows):
        present[k, row["present"]] = 1
    whole = np.array([r["whole"] for r in rows], dtype=np.float32)
    ballots = votes(present, whole)
    posterior = LabelModel().fit(ballots, y).posterior(ballots)
    return Model(terms, fit_linear(inputs(present, whole), posterior), float(rate))


def score_of(docs: DataFrame, model: Model) -> Column:
    """Score of the column ``text`` of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_TERMS terms and weights

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts))

    return scored(F.coalesce(docs["text"], F.lit("")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = fit(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_of(docs, model).alias("score"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents without those predicted to be toxic; all columns stay."""
    return docs.where(score_of(docs, fit(docs, labels)) < THRESHOLD)
