"""Lempel-Ziv phrase fingerprints.

A text is parsed left to right into dictionary phrases: each phrase is the shortest piece that the
dictionary does not hold yet (LZ78). The set of phrase hashes stands for the text, and is kept as the
least values of ``SLOTS`` permutations. The share of equal slots estimates how many phrases two texts have
in common, which is what one text saves when compressed with the other's dictionary.

``edited_pairs`` also fingerprints each document after its last third was replaced by the begin of the next
document, in descending doc_id. Rows are range-partitioned once; each task streams its sorted rows and hands
over only its first and last row, which a second, small step pairs across partitions.

Cases: a null text counts as empty; empty texts have the fingerprint of the empty set and are alike; null
doc_ids come last in the order; equal doc_ids are ordered by a hash of the text; repeated rows stay; other
columns are ignored; an only row is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairload.llm.common import written

SLOTS = 64
WORD = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15  # odd multiplier of the rolling phrase hash
PERMUTATIONS = np.random.RandomState(7).randint(1, 2**63, size=(2, SLOTS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
EMPTY = np.full(SLOTS, 0xFFFF, dtype=np.uint16)


def parse(codes: Iterable[int], phrases: set, open_phrase: int = 0) -> int:
    """Add the phrases of ``codes`` to the dictionary; gives the hash of the phrase still open."""
    phrase = open_phrase
    for code in codes:
        phrase = ((phrase + code + 1) * STEP) & WORD
        if phrase not in phrases:
            phrases.add(phrase)
            phrase = 0
    return phrase


def signature(phrases: set) -> np.ndarray:
    """Which phrase has the least of each permutation's values: 16 bits of its hash a slot.

    The least values themselves get small when there are many phrases, so that their upper bits agree for
    unrelated long texts; their bits are mixed once more and the low ones kept.
    """
    if not phrases:
        return EMPTY
    mixed = np.fromiter(phrases, dtype=np.uint64, count=len(phrases))
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    least = np.full(SLOTS, WORD, dtype=np.uint64)
    factor, shift = PERMUTATIONS
    for at in range(0, len(mixed), 2048):  # bounded memory for very long texts
        values = mixed[at : at + 2048, None] * factor + shift
        np.minimum(least, values.min(axis=0), out=least)
    least ^= least >> np.uint64(32)
    least *= np.uint64(0xBF58476D1CE4E5B9)
    return (least >> np.uint64(48)).astype(np.uint16)


def printed(slots: np.ndarray) -> str:
    return slots.astype(">u2").tobytes().hex()


def code_points(text: str) -> list[int]:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").tolist()


def with_edit(text: str, following: str) -> tuple:
    """(n_chars, digest of the edited text, signature, edited signature).

    The text and its edit share their first two thirds, which are parsed once.
    """
    third = len(text) // 3
    kept, fresh = len(text) - third, following[:third]
    codes, phrases = code_points(text), set()
    open_phrase = parse(codes[:kept], phrases)
    edited = set(phrases)
    parse(codes[kept:], phrases, open_phrase)
    parse(code_points(fresh), edited, open_phrase)
    digest = hashlib.sha256((text[:kept] + fresh).encode("utf-8")).hexdigest()
    return len(text), digest, signature(phrases), signature(edited)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SLOTS


RESULT = (
    "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]


def _row(doc_id: str | None, made: tuple, following: np.ndarray) -> tuple:
    n, digest, own, edited = made
    return doc_id, n, digest, printed(own), printed(edited), likeness(own, edited), likeness(own, following)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS)


def _stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results for all rows of a partition but its last, and its first and last row as edges."""
    part = TaskContext.get().partitionId()

    def edge(kind: str, doc_id: str | None, text: str) -> pd.DataFrame:
        out = _frame([(doc_id, 0, None, None, None, None, None)])
        return out.assign(edge=kind, part=part, text=text)

    held: tuple | None = None  # a row whose next text is not known yet
    made: tuple | None = None  # its id and all but the next row's signature
    for frame in frames:
        rows = []
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            if held is None:
                yield edge("first", doc_id, text)
            else:
                now = (held[0], with_edit(held[1], text))
                if made is not None:
                    rows.append(_row(made[0], made[1], now[1][2]))
                made = now
            held = (doc_id, text)
        if rows:
            yield _frame(rows).assign(edge=None, part=part, text=None)
    if held is not None:
        if made is not None:
            alone = set()
            parse(code_points(held[1]), alone)
            yield _frame([_row(made[0], made[1], signature(alone))]).assign(edge=None, part=part, text=None)
        yield edge("last", *held)


def _pair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc_id, text, following in zip(frame["doc_id"], frame["text"], frame["following"]):
            phrases: set = set()
            parse(code_points(following), phrases)
            made = with_edit(text, following)
            rows.append(_row(doc_id, made, signature(phrases)))
        yield _frame(rows)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """One row per document; see ``RESULT`` for the columns."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    streamed = written(
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # pandas would round ids beside nulls
        .mapInPandas(_stream, f"{RESULT}, edge string, part int, text string"),
        "lz",
    )
    inner = streamed.where(F.col("edge").isNull()).select(*COLUMNS)

    # two rows a partition: whom the last row of each partition is followed by
    first = streamed.where("edge = 'first'").select("part", F.col("text").alias("following"))
    parts_in_order = Window.orderBy("part")
    after = first.select(
        F.col("part").alias("own"),
        F.coalesce(F.lead("part").over(parts_in_order), F.first("part").over(parts_in_order)).alias("part"),
    )
    last = streamed.where("edge = 'last'").select("doc_id", "text", F.col("part").alias("own"))
    edges = last.join(after, "own").join(first, "part").select("doc_id", "text", "following")
    return inner.unionByName(edges.mapInPandas(_pair, RESULT)).withColumn("doc_id", F.col("doc_id").cast("long"))
