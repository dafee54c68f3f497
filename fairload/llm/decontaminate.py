"""Benchmark decontamination by SimHash over item-sized windows.

For every benchmark item of n words, windows of n words slide over each whole document. A window's word
shingles (five words) give a 64-bit SimHash; windows of a text are sums of a running total, so each costs one
subtraction. Fingerprints of items are entered in eight tables, one for each block of eight bits, under every
value within ``BALL`` bits of the block. Two fingerprints within ``RADIUS`` bits agree in some block up to
``RADIUS // 8`` bits, so looking up the window's own blocks finds every item within the radius. The complete
distance is checked, and then the exact similarity of the shingles weighted by their counts
(sum of the lesser counts over sum of the greater); 0.8 or more is a finding.

A document of fewer words than the item is one window, with its own number of shingles.

Windows that share too few shingles with all items of their size together are not fingerprinted. The radius is wide:
shingle sets that are 0.8 alike differ in 9.7 of 64 bits on average, with a deviation of 2.9. That holds if no shingle
repeats: one heavy shingle can turn most bits. So if one repeats in the item or in the window, the similarity is
taken at any distance.

Benchmark items are taken in blocks of at most ``BLOCK_CHARS`` characters. One block is broadcast at a time and
compared with all documents, so memory is bounded for a benchmark of any size.

Words are runs of letters and digits in lower case. Items and windows of fewer than five words have one
shingle, the whole sequence, and so match only equal sequences.

Cases: a null text counts as empty and matches nothing, on either side; items without words match nothing;
null ids are kept as nulls; repeated documents give repeated findings; repeated items give a finding each;
other columns are ignored; an empty table gives an empty result. Of several windows of a document that match
an item, the one most alike is reported, the first on ties.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 8
RADIUS = 23
BALL = RADIUS // BLOCKS
BLOCK_CHARS = 4_000_000
WINDOWS_AT_ONCE = 4096
KNOWN_WORDS = 500_000  # entries of a task's word-hash cache before it starts anew

WORD = re.compile(r"\w+")
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63])
MIX = MIX.astype(np.uint64)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text: str) -> np.ndarray:
        return np.array([self[w] for w in WORD.findall(text.lower())], dtype=np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + n]) * MIX[k]
        out ^= out >> np.uint64(29)
    return out


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class Item(NamedTuple):
    item_id: int | None
    words: int
    shingles: np.ndarray  # distinct, sorted
    counts: np.ndarray
    print: int


class Index:
    """One block of benchmark items, by shingle and by fingerprint."""

    def __init__(self, rows: list[tuple[int | None, str]]) -> None:
        hashes = WordHashes()
        self.items: list[Item] = []
        for item_id, text in rows:
            words = hashes.of(text or "")
            if not len(words):
                continue
            each = shingle_hashes(words, min(SHINGLE, len(words)))
            shingles, counts = np.unique(each, return_counts=True)
            mark = int(packed(bits_of(each).sum(axis=0, dtype=np.int32)[None])[0])
            self.items.append(Item(item_id, len(words), shingles, counts, mark))
        # which sizes of window a shingle asks for; by length of the shingle
        self.sizes: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for length in sorted({min(SHINGLE, i.words) for i in self.items}):
            asked: dict[int, set] = {}
            for item in self.items:
                if min(SHINGLE, item.words) == length:
                    for s in item.shingles.tolist():
                        asked.setdefault(s, set()).add(item.words)
            keys = sorted(asked)
            self.sizes[length] = np.array(keys, dtype=np.uint64), [sorted(asked[k]) for k in keys]
        self.prints = np.array([i.print for i in self.items], dtype=np.uint64)
        self.words = np.array([i.words for i in self.items])
        # items by size: all, and those in which a shingle repeats
        self.of_size: dict[int, list[int]] = {}
        self.heavy: dict[int, list[int]] = {}
        for k, item in enumerate(self.items):
            self.of_size.setdefault(item.words, []).append(k)
            if item.counts.max() > 1:
                self.heavy.setdefault(item.words, []).append(k)
        self.tables = self._tables()

    def _tables(self) -> np.ndarray:
        """[block, value] -> items, as a bit row."""
        values = np.arange(256, dtype=np.uint8)
        out = []
        for block in range(BLOCKS):
            own = ((self.prints >> np.uint64(8 * block)) & np.uint64(255)).astype(np.uint8)
            out.append(np.packbits(np.bitwise_count(values[:, None] ^ own) <= BALL, axis=1))
        return np.stack(out)

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for items of ``size`` words within the radius."""
        rows = np.zeros((len(prints), self.tables.shape[2]), dtype=np.uint8)
        for block in range(BLOCKS):
            rows |= self.tables[block][((prints >> np.uint64(8 * block)) & np.uint64(255)).astype(np.int64)]
        window, item = np.nonzero(np.unpackbits(rows, axis=1, count=len(self.items)))
        same = self.words[item] == size
        window, item = window[same], item[same]
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[near], item[near]

    def find(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, bits apart) of its best window."""
        best: dict[int, tuple[float, int, int]] = {}
        for length, (keys, sizes) in self.sizes.items():
            each = shingle_hashes(words, length)
            if not len(each):
                continue
            place = np.minimum(np.searchsorted(keys, each), len(keys) - 1)
            hit = np.nonzero(keys[place] == each)[0]
            if not len(hit):
                continue
            hits_of: dict[int, list[int]] = {}
            for at in hit.tolist():
                for size in sizes[place[at]]:
                    hits_of.setdefault(size, []).append(at)
            for size, at in hits_of.items():
                self._windows(each, len(words), length, size, np.array(at), best)
        return best

    def _windows(
        self, each: np.ndarray, n_words: int, length: int, size: int, at: np.ndarray, best: dict
    ) -> None:
        """All windows of ``size`` words that hold a shingle of ``at``."""
        asked = size - length + 1  # shingles in an item
        held = min(asked, len(each))  # and in a window: a shorter document is one
        low, high = np.maximum(at - held + 1, 0), np.minimum(at, max(n_words - size, 0))
        known = np.zeros(len(each), dtype=bool)
        known[at] = True
        edge = np.zeros(len(each) + 2, dtype=np.int32)
        fits = low <= high
        np.add.at(edge, low[fits], 1)
        np.add.at(edge, high[fits] + 1, -1)
        starts = np.nonzero(np.cumsum(edge) > 0)[0]
        # stretches of windows that follow one another share a running total
        for stretch in np.split(starts, np.nonzero(np.diff(starts) > 1)[0] + 1):
            for k in range(0, len(stretch), WINDOWS_AT_ONCE):
                part = stretch[k : k + WINDOWS_AT_ONCE]
                if len(part):
                    span = slice(part[0], part[-1] + held)
                    self._compare(each[span], known[span], int(part[0]), held, asked, size, best)

    def _compare(
        self, each: np.ndarray, known: np.ndarray, start: int, held: int, asked: int, size: int, best: dict
    ) -> None:
        shared = np.cumsum(np.concatenate([[0], known]))
        shared = shared[held:] - shared[:-held]
        enough = shared / (held + asked - shared) >= SIMILARITY  # no window of others can be alike
        if not enough.any():
            return
        total = np.zeros((len(each) + 1, 64), dtype=np.int32)
        np.cumsum(bits_of(each), axis=0, out=total[1:])
        prints = packed(total[held:] - total[:-held])
        pairs = {(w, k) for w, k in zip(*(x.tolist() for x in self.candidates(prints, size))) if enough[w]}
        for window in np.nonzero(enough)[0].tolist():
            repeats = len(np.unique(each[window : window + held])) < held
            pairs.update((window, k) for k in (self.of_size if repeats else self.heavy).get(size, []))
        for window, item in sorted(pairs):
            own = self.items[item]
            part = each[window : window + held]
            place = np.minimum(np.searchsorted(own.shingles, part), len(own.shingles) - 1)
            shared = own.shingles[place] == part
            if shared.sum() / (held + asked - shared.sum()) < SIMILARITY:
                continue  # too few even if no shingle repeats
            common = np.minimum(np.bincount(place[shared], minlength=len(own.counts)), own.counts).sum()
            alike = float(common / (held + asked - common))
            if alike >= SIMILARITY and (item not in best or alike > best[item][0]):
                apart = int(np.bitwise_count(prints[window] ^ self.prints[item]))
                best[item] = (alike, start + window, apart)


FOUND = "item_id: long, similarity: double, first_word: long, bits_apart: int"


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items, a bounded number of characters at a time."""
    rows, chars = [], 0
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if rows and chars + len(row["text"]) > BLOCK_CHARS:
            yield rows
            rows, chars = [], 0
        rows.append((row["item_id"], row["text"]))
        chars += len(row["text"])
    if rows:
        yield rows


def _findings(rows: list[tuple[int | None, str]], docs: DataFrame) -> Column:
    """Items of one block that the column ``text`` holds, as an array."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)  # BLOCK_CHARS bounds it
    names = [c.split(":")[0] for c in FOUND.split(", ")]

    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, hashes = Index(shared.value), WordHashes()
        for texts in parts:
            out = []
            for text in texts:
                found = index.find(hashes.of(text)) if index.items else {}
                out.append([dict(zip(names, (index.items[k].item_id, *found[k]))) for k in sorted(found)])
            yield pd.Series(out)

    return F.pandas_udf(scan, f"array<struct<{FOUND}>>")(F.coalesce(docs["text"], F.lit("")))


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, bits_apart) of every document that holds an item."""
    found = None
    for rows in blocks_of(benchmark):
        here = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.inline(_findings(rows, docs)))
        found = here if found is None else found.unionByName(here)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id: long, {FOUND}")
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item was found; all columns stay, a null doc_id too if its text is clean."""
    clean = docs
    for rows in blocks_of(benchmark):
        clean = clean.where(F.size(_findings(rows, docs)) == 0)
    return clean
