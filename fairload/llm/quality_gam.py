"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a few measures (shares of kinds of characters, word and line statistics, repetition). Each
measure is cut into bins. Cyclic boosting goes round and round over the measures; each visit fits a shallow
tree on the bins of that one measure to the current errors and adds a small part of it to the measure's
table. The pairs of measures whose joint bins explain most of what is left get tables of their own, boosted
in the same way. A score is an intercept plus one table entry a measure and a pair: binned lookups, added up
for a whole batch at once.

Fitted on the driver from at most ``MAX_ROWS`` rows of ``len(MEASURES)`` numbers. Scores cover all documents.
Labels are used only for ids that are not held out; neither lang, source nor doc_id enters a score.

Cases: as in ``toxicity``: a null text counts as empty; a null doc_id is scored and not held out; labels with
a null id or value are left out and several labels of an id count by their mean; repeated rows stay; other
columns are ignored; without labels every score is 0.5, with one class only the smoothed base rate.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairload.llm.common import held_out
from fairload.llm.toxicity import labelled_sample

MAX_ROWS = 20_000  # labelled rows used for fitting
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 8
RATE, LEAST_LEAF, RIDGE = 0.1, 12, 2.0
FOLDS, FOLD = 4, 2
THRESHOLD = 0.7

MEASURES = (
    "log_chars", "log_words", "upper", "digit", "symbol", "bar", "bang", "stop", "high", "space", "newline",
    "word_length", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "line_words", "odd_words",
    "repeat_run", "sentence_words",
)
PLAIN_WORD = re.compile(r"[^\W\d_]+[.,;:?!]?")
SYMBOLS = np.frombuffer(b"#$%&*@^~<>=+_\\/{}[]", dtype=np.uint8)


def measure(text: str) -> list[float]:
    """The measures of one whole text."""
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    counts, size = np.bincount(data, minlength=256), max(len(data), 1)
    words = text.split()
    n = max(len(words), 1)
    often = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    run = best = 0
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 0
        best = max(best, run)
    ends = counts[ord(".")] + counts[ord("?")] + 1
    plain = sum(c for w, c in often.items() if PLAIN_WORD.fullmatch(w))
    share = lambda *codes: float(counts[list(codes)].sum()) / size
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        float(counts[65:91].sum()) / size,
        float(counts[48:58].sum()) / size,
        share(*SYMBOLS),
        share(ord("|")),
        share(ord("!")),
        share(ord("."), ord(",")),
        float(counts[128:].sum()) / size,
        share(32),
        share(10),
        sum(map(len, words)) / n,
        len(often) / n,
        max(often.values(), default=0) / n,
        pairs / max(n - 1, 1),
        len(set(lines)) / max(len(lines), 1),
        float(np.log1p(n / max(len(lines), 1))),
        1 - plain / n,
        float(np.log1p(best)),
        float(np.log1p(n / ends)),
    ]


# --- fitting ------------------------------------------------------------------------------------------


def tree_on_bins(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values over ordered bins of the regression tree of ``depth`` that cuts best."""
    value = np.full(len(gradient), gradient.sum() / (weight.sum() + RIDGE))
    if depth == 0 or len(gradient) < 2:
        return value
    g, h, r = np.cumsum(gradient), np.cumsum(weight), np.cumsum(rows)
    gain = g[:-1] ** 2 / (h[:-1] + RIDGE) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + RIDGE)
    gain[(r[:-1] < LEAST_LEAF) | (r[-1] - r[:-1] < LEAST_LEAF)] = -np.inf
    cut = int(np.argmax(gain))
    if not gain[cut] > g[-1] ** 2 / (h[-1] + RIDGE) + 1e-9:
        return value
    sides = (slice(0, cut + 1), slice(cut + 1, None))
    return np.concatenate([tree_on_bins(gradient[s], weight[s], rows[s], depth - 1) for s in sides])


def tree_on_grid(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Leaf values over a grid: one cut on one axis, then one on the other in each part; the best of all such.

    The first cut is judged by what the second ones gain: two measures that only matter together gain nothing
    from a first cut alone.
    """
    best, best_gain = None, -np.inf
    for turned in (False, True):
        g, h, r = (x.T if turned else x for x in (gradient, weight, rows))
        for cut in range(len(g)):  # 0: no first cut
            bands = [b for b in (slice(0, cut), slice(cut, None)) if len(g[b])]
            if cut and min(r[b].sum() for b in bands) < LEAST_LEAF:
                continue
            out = np.empty_like(g)
            for band in bands:
                out[band] = tree_on_bins(g[band].sum(axis=0), h[band].sum(axis=0), r[band].sum(axis=0), 1)
            gain = float((g * out).sum() - 0.5 * (h * out**2).sum())
            if gain > best_gain:
                best, best_gain = (out.T if turned else out), gain
    return best


class Additive(NamedTuple):
    """Bin edges and tables; ``pairs`` holds (measure, measure, table over the coarse bins of both)."""

    intercept: float
    edges: list
    tables: list
    coarse: list
    pairs: list

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, entries) in enumerate(zip(self.edges, self.tables)):
            total += entries[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, entries in self.pairs:
            at = (np.searchsorted(self.coarse[k], x[:, k], side="right") for k in (a, b))
            total += entries[tuple(at)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_additive(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit to soft labels 0..1."""
    rate = (y.sum() + 1) / (len(y) + 2)
    cuts = lambda values, n: np.unique(np.quantile(values, np.arange(1, n) / n))
    width = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        blank = [np.empty(0)] * width
        return Additive(float(np.log(rate / (1 - rate))), blank, [np.zeros(1)] * width, blank, [])
    edges = [cuts(x[:, j], BINS) for j in range(width)]
    coarse = [cuts(x[:, j], PAIR_BINS) for j in range(width)]
    at = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(width)]
    rough = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(width)]
    sizes = [len(e) + 1 for e in edges]
    rows_in = [np.bincount(at[j], minlength=sizes[j]) for j in range(width)]
    tables = [np.zeros(n) for n in sizes]
    intercept = float(np.log(rate / (1 - rate)))
    total = np.full(len(y), intercept)

    def errors() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = errors()
            sums = [np.bincount(at[j], weights=v, minlength=sizes[j]) for v in (g, h)]
            step = RATE * tree_on_bins(*sums, rows_in[j], 2)
            tables[j] += step
            total += step[at[j]]

    g, h = errors()
    cells = {}
    for a in range(width):
        for b in range(a + 1, width):
            shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
            cells[a, b] = (rough[a] * shape[1] + rough[b], shape)
    grid = lambda ab, v: np.bincount(cells[ab][0], weights=v, minlength=np.prod(cells[ab][1])).reshape(cells[ab][1])
    rows_of = {}
    gains = {}
    for ab in cells:
        sums = grid(ab, g), grid(ab, h)
        rows_of[ab] = grid(ab, None)
        out = tree_on_grid(*sums, rows_of[ab])
        gains[ab] = float((sums[0] * out).sum() - 0.5 * (sums[1] * out**2).sum())
    chosen = sorted(gains, key=lambda ab: (-gains[ab], ab))[:PAIRS]
    joint = {ab: np.zeros(cells[ab][1]) for ab in chosen}
    for _ in range(PAIR_ROUNDS):
        for ab in chosen:
            g, h = errors()
            step = RATE * tree_on_grid(grid(ab, g), grid(ab, h), rows_of[ab])
            joint[ab] += step
            total += step.ravel()[cells[ab][0]]
    return Additive(intercept, edges, tables, coarse, [(a, b, joint[a, b]) for a, b in chosen])


# --- on Spark -----------------------------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Additive:
    def see(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen = [measure(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "x": seen})

    sample = labelled_sample(docs, labels, column, FOLDS, FOLD, MAX_ROWS)
    kept = sample.mapInPandas(see, "doc_id long, label double, x array<double>").orderBy("doc_id")
    rows = kept.collect()  # MAX_ROWS bounds it
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(MEASURES))
    return fit_additive(x, np.array([r["label"] for r in rows], dtype=np.float64))


def score_of(docs: DataFrame, model: Additive) -> Column:
    """Score of the column ``text`` of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table a measure and a pair: some KB

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        x = np.array([measure(t) for t in texts], dtype=np.float64).reshape(len(texts), len(MEASURES))
        return pd.Series(shared.value.score(x))

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
