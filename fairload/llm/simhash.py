"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits. It is cut into two segments of 32; fingerprints that differ in at most
``max_bits`` (3) bits differ in at most one bit of one segment. So each distinct fingerprint is entered in
a table under the value of each segment, every value of a small Hamming ball around each segment is looked
up in that table, and the complete distance is checked. Balls only set bits, never clear them: of two
segments that differ in one bit, exactly one finds the other.

Exact copies meet in one distinct fingerprint before any lookup, so copies are never expanded into pairs.

Cases: a null text counts as empty; texts without words have fingerprint zero and link like any other; a
null doc_id keeps its row and never names a group unless all its members lack one; repeated rows stay;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairload.llm.common import written
from fairload.llm.components import components

SEGMENT_BITS = 32
SEED = 42


def fingerprint(text: str, shingle: int) -> int:
    """Bit i is 1 if set in over half the XXH64 of all word shingles, repeats included."""
    words = text.encode("utf-8").lower().split()  # on bytes: A-Z only, and space or \t..\r only
    if not words:
        return 0
    shingles = [b" ".join(w) for w in zip(*(words[k:] for k in range(shingle)))] or [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_of(shingle: int) -> Column:
    """Fingerprint of the column ``text`` as a signed long."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return F.pandas_udf(run, "long")(F.coalesce("text", F.lit("")))


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * k).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (src, dst) of distinct ``fp`` values at most ``max_bits`` apart."""
    if max_bits > 3:
        raise ValueError("two segments with balls of one bit reach 3 bits")
    fp, ones = F.col("fp"), [1 << k for k in range(SEGMENT_BITS)]
    segments = F.array(*(F.struct(F.lit(k).alias("seg"), _segment(fp, k).alias("val")) for k in range(2)))
    entries = distinct.select("fp", F.inline(segments))
    ball = F.filter(F.array(*map(F.lit, ones)), lambda bit: F.col("val").bitwiseAND(bit) == 0)
    ball = F.concat(F.array(F.lit(0).cast("long")), F.transform(ball, lambda bit: bit.cast("long")))
    probes = entries.select(F.col("fp").alias("src"), "seg", F.explode(ball).alias("bit"), "val").select(
        "src", "seg", F.col("val").bitwiseOR(F.col("bit")).alias("val"), "bit"
    )
    # the planner takes the exploded balls for no larger than the fingerprints and would broadcast all of them
    found = entries.withColumnRenamed("fp", "dst").join(probes.hint("merge"), ["seg", "val"])
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits
    once = (F.col("bit") != 0) | (F.col("src") < F.col("dst"))  # equal segments find each other both ways
    # fingerprints that differ by one bit in each segment find each other from both sides
    return found.where(near & once).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _groups(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root): the group of each distinct fingerprint."""
    roots = components(links(distinct, max_bits), "simhash-components").withColumnRenamed("node", "fp")
    return distinct.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_of(shingle).alias("fp"))
    printed = written(ids, "simhash")
    distinct = written(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    named = distinct.join(_groups(distinct, max_bits), "fp")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return printed.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One document of each group: the smallest doc_id, then the least hash of the text; columns as before.

    Rows that repeat both doc_id and text are one document.
    """
    key = [
        F.col("doc_id").isNull().alias("k_none"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k_id"),
        F.xxhash64("text").alias("k_text"),
    ]
    printed = written(docs.select(*key, fingerprint_of(shingle).alias("fp")), "simhash")
    first = F.min(F.struct("k_none", "k_id", "k_text")).alias("first")
    distinct = written(printed.groupBy("fp").agg(first), "simhash-distinct")
    kept = distinct.join(_groups(distinct, max_bits), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select("first.*")
    rows = docs.select(F.struct("*").alias("d"), *key)
    names = ["k_none", "k_id", "k_text"]
    return rows.join(kept, names).dropDuplicates(names).select(*(F.col(f"d.`{c}`").alias(c) for c in docs.columns))
