"""Ranked lexical search by the Best Position Algorithm.

Every query item has an impact list for each of its terms: documents by falling contribution to the score. Lists
are read in step from the top. Each document met gets its whole score at once by direct access to the other
lists, and its place in every list counts as seen. The best position of a list is the end of its unbroken run of
seen places, usually far beyond the last place read. No unseen document can score more than the sum of the
contributions at the best positions; reading stops when that is strictly below the k-th score, so ties are whole.

Each task takes its documents in blocks, builds the impact lists of a block and reads them for all items; the k-th
score so far carries over to the next block. A task gives out its best k of each item, and the best k of all tasks
are chosen by a window. Items come in blocks of bounded length, each broadcast and freed again. Counts over all
documents (documents with terms, terms, documents of a term) are exact sums of a first pass.

Cases: null texts and texts without terms have no score and do not count; an item without terms, or with a null
text, has no rows; repeated items are one item; items of the same id with other texts are ranked apart; repeated
documents each have a rank; a null doc_id ranks behind its ties; other columns are ignored; empty tables give an
empty result. Very long texts are taken whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairload.llm.common import written

#: Characters of item texts in one broadcast, and cells of a block of documents (terms x documents, 8 bytes each).
BLOCK_CHARS = 4_000_000
BLOCK_CELLS = 4_000_000
#: Places read of each list in the first round; doubled with each round.
FIRST_DEPTH = 8

#: Letters, digits and all beyond ASCII stay, A-Z in lower case; the rest parts terms.
_TERMS = bytes(b if b > 0x7F or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TERMS).split()


class Items(NamedTuple):
    """A block of items: their numbers and ids, the number of each term, and each item's (terms, repeats)."""

    numbers: list
    ids: list
    terms: dict
    wanted: list


def blocks_of(items: DataFrame) -> Iterator[Items]:
    """Distinct items in blocks of at most BLOCK_CHARS characters, or of one item that is longer."""
    numbers, ids, terms, wanted, chars, number = [], [], {}, [], 0, 0
    rows = items.where("text is not null").select("item_id", "text").distinct()
    for row in rows.toLocalIterator():
        found = Counter(terms_of(row.text))
        if not found:
            continue
        if numbers and chars + len(row.text) > BLOCK_CHARS:
            yield Items(numbers, ids, terms, wanted)
            numbers, ids, terms, wanted, chars = [], [], {}, [], 0
        at = [terms.setdefault(t, len(terms)) for t in found]
        wanted.append((np.array(at), np.array(list(found.values()), dtype=np.int64)))
        numbers.append(number)
        ids.append(row.item_id)
        chars += len(row.text)
        number += 1
    if numbers:
        yield Items(numbers, ids, terms, wanted)


class Corpus(NamedTuple):
    documents: int
    terms: int
    holding: np.ndarray  # documents that hold each term


def corpus_counts(docs: DataFrame, items: Items, table) -> Corpus:
    """Documents with terms, all their terms, and for each term of the items the documents that hold it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = table.value.terms
        documents, length, holding = 0, 0, np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                words = terms_of(text)
                documents += bool(words)
                length += len(words)
                at = [terms[w] for w in set(words) & terms.keys()]
                holding[at] += 1
        at = np.flatnonzero(holding)
        yield pd.DataFrame({"at": [-2, -1, *at], "n": [documents, length, *holding[at]]})

    sums = docs.select("text").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found = {r["at"]: r["n"] for r in sums.toLocalIterator()}  # a row a term of the block
    holding = np.array([found.get(k, 0) for k in range(len(items.terms))], dtype=np.int64)
    return Corpus(found.get(-2, 0), found.get(-1, 0), holding)


def weights(corpus: Corpus) -> np.ndarray:
    n = corpus.documents
    return np.array([floor(1000 * log((2 * n + 2) / (2 * int(df) + 1))) for df in corpus.holding], dtype=np.int64)


class Lists:
    """Impact lists of one block of documents, with direct access by (term, document)."""

    def __init__(self, texts: list, items: Items, corpus: Corpus, weight: np.ndarray) -> None:
        self.impact = np.zeros((len(items.terms), len(texts)), dtype=np.int64)
        for d, text in enumerate(texts):
            words = terms_of(text)
            at = [t for t in map(items.terms.get, words) if t is not None]
            if at:
                held, tf = np.unique(np.array(at), return_counts=True)
                m = 100 - 25 + (25 * len(words) * corpus.documents) // corpus.terms
                self.impact[held, d] = weight[held] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
        term, doc = np.nonzero(self.impact)
        order = np.lexsort((doc, -self.impact[term, doc], term))
        self.docs = doc[order]
        self.values = self.impact[term, doc][order]
        self.bounds = np.searchsorted(term, np.arange(len(items.terms) + 1))


def best_positions(lists: Lists, terms: np.ndarray, repeats: np.ndarray, k: int, floor_score: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the block that can be among the best k; ``floor_score`` is the k-th score so far.

    Every document of the block that scores ``floor_score`` or more and is not beaten by k others is there.
    """
    parts = [(lists.bounds[t], lists.bounds[t + 1], r) for t, r in zip(terms, repeats) if lists.bounds[t] < lists.bounds[t + 1]]
    ranked = [(lists.docs[a:b], lists.values[a:b], r) for a, b, r in parts]
    seen = np.zeros(lists.impact.shape[1], dtype=bool)
    best, depth, step = [0] * len(ranked), 0, FIRST_DEPTH
    docs, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    while ranked:
        met = np.concatenate([d[depth : depth + step] for d, _, _ in ranked])  # sorted access
        fresh = np.unique(met[~seen[met]])
        seen[fresh] = True
        docs = np.concatenate((docs, fresh))
        scores = np.concatenate((scores, repeats @ lists.impact[np.ix_(terms, fresh)]))  # direct access
        depth, step = depth + step, step * 2
        limit = 0
        for i, (d, values, r) in enumerate(ranked):
            best[i] = _run_end(seen, d, max(best[i], min(depth, len(d))))
            if best[i] < len(d):  # all of a list seen: an unseen document has nothing of it
                limit += int(r) * int(values[best[i] - 1])
        kth = int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0
        if limit < max(kth, floor_score) or limit == 0:
            break
    return docs, scores


def _run_end(seen: np.ndarray, docs: np.ndarray, start: int) -> int:
    """End of the unbroken run of seen places from ``start``."""
    step = 64
    while start < len(docs):
        unseen = np.flatnonzero(~seen[docs[start : start + step]])
        if len(unseen):
            return start + int(unseen[0])
        start, step = start + step, step * 2
    return len(docs)


def _best(scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, missing, -scores))[:k]


def search_block(docs: DataFrame, items: Items, corpus: Corpus, k: int, table) -> DataFrame:
    """(number, doc_id, score): the best k of each item in each task."""
    weight = weights(corpus)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = table.value
        size = max(16, BLOCK_CELLS // len(items.terms))
        none = np.empty(0, dtype=np.int64)
        kept = [(none, none, none) for _ in items.numbers]  # scores, ids, whether the id is missing
        for batch in batches:
            known = batch["doc_id"].notna().to_numpy()
            ids = np.array([int(i) if ok else 0 for i, ok in zip(batch["doc_id"], known)], dtype=np.int64)
            texts = list(batch["text"])
            for at in range(0, len(texts), size):
                lists = Lists(texts[at : at + size], items, corpus, weight)
                for number, (terms, repeats) in enumerate(items.wanted):
                    before = kept[number]
                    least = int(before[0][-1]) if len(before[0]) == k else 0
                    found, scores = best_positions(lists, terms, repeats, k, least)
                    good = (scores > 0) & (scores >= least)
                    if good.any():
                        found = found[good] + at
                        now = (scores[good], ids[found], (~known[found]).astype(np.int64))
                        now = [np.concatenate(x) for x in zip(before, now)]
                        best = _best(*now, k)
                        kept[number] = tuple(x[best] for x in now)
        for number, (scores, ids, missing) in zip(items.numbers, kept):
            if len(scores):
                out = [None if gone else str(i) for i, gone in zip(ids, missing)]
                yield pd.DataFrame({"number": number, "doc_id": out, "score": scores})

    named = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    return named.mapInPandas(run, "number long, doc_id string, score long").withColumn("doc_id", F.col("doc_id").cast("long"))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest scores above 0 of each item, ties by ascending doc_id."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], "item_id long, number long, doc_id long, score long")
    for block in blocks_of(items.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        table = spark.sparkContext.broadcast(block)
        corpus = corpus_counts(docs, block, table)
        best = search_block(docs, block, corpus, k, table)
        ids = spark.createDataFrame(list(zip(block.numbers, block.ids)), "number long, item_id long")
        best = written(best.join(F.broadcast(ids), "number"), "ranked-search")  # a row an item of the block
        table.destroy()
        found = found.unionByName(best)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
