"""N-gram Jaccard join by several global token orders.

A document is its set of distinct word shingles. Documents with equal sets are one node, named by a hash of
the set. Two sets that are alike enough share tokens among the first few of each (the prefix), whatever the
global order in which tokens are taken. All orders here put rare tokens first, by a table of counts in hashed
buckets, and differ in how ties are broken. A pair is a candidate if the prefixes of the first order meet and
parity sketches of the sets differ in no more bits than the sets may differ in tokens (they never differ in more).
It is kept only if the prefixes of every further order share as many tokens as the likeness demands; only then are
the whole sets compared.

Near copies are not expanded into pairs. In each long prefix list every node is first compared with one head,
the node that shares most tokens with others. Lists whose nodes are all in one component then are done. In the
others, pairs of nodes of different components are compared, by length and by place in the prefixes before
anything else. No list, pair or partner is left out, so no link between components is lost.

Texts are read four times, where they lie: for keys and counts, for prefixes, and once for the sets of each of
the two rounds, which a filter of fixed size restricts to documents that still have a candidate.

Cases: null texts and texts without words have no shingles and link with nothing; a text with fewer words than
a shingle is one shingle; a null doc_id keeps its row and never names a group unless all its members lack one;
repeated rows stay, as copies; other columns are ignored; an empty table gives an empty result. Very long
texts are taken whole; a task holds one Arrow batch of texts. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairload.llm.common import written
from fairload.llm.components import components

ORDERS = 3
#: Buckets of the table of token counts (a byte a bucket is broadcast).
BUCKETS = 1 << 16
#: Most words of 64 bits of the document filter.
MOST_FILTER_WORDS = 1 << 21
#: A prefix list of so many nodes or more is compared with a head first.
LONG_LIST = 8
#: Where the probes of a hash lie: shift of the word number, shift of the bit number.
PROBES = ((0, 41), (20, 47), (11, 53), (31, 5))
#: Nodes that a task remembers to give out copies only once.
REMEMBERED = 1 << 20

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())

class _Hashes(dict):
    """XXH3 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _Hashes()
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))) * _MIX
    x ^= x >> np.uint64(29)
    x *= _STEP
    return x ^ (x >> np.uint64(32))


def tokens_of(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()  # bytes split at space and \t..\r only
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(shingle, len(hashes))
    total = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total = total * _STEP + hashes[k : len(hashes) - size + 1 + k]
    return np.unique(_mixed(total, 0))


def prefix_length(n: int, percent: int) -> int:
    """A set of n shares a token of so many first ones with every set that is ``percent`` alike."""
    return n - (percent * n + 99) // 100 + 1


def _keys(tokens: np.ndarray) -> tuple[int, int]:
    found = xxhash.xxh3_128_digest(tokens.astype("<u8").tobytes())
    both = np.frombuffer(found, dtype="<i8")
    return int(both[0]), int(both[1])


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens % np.uint64(BUCKETS)).astype(np.int64)


def _counted(docs: DataFrame, shingle: int) -> DataFrame:
    """A row a document (doc_id, n, k1, k2), and a row a task with its counts of hashed tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            sets = [tokens_of(text, shingle) for text in batch["text"]]
            if sets:
                counts += np.bincount(_bucket(np.concatenate(sets)), minlength=BUCKETS)
            keys = np.array([_keys(tokens) for tokens in sets], dtype=np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": [len(t) for t in sets], "k1": keys[:, 0], "k2": keys[:, 1], "at": None, "counts": None})
        at = np.flatnonzero(counts)
        if len(at):
            yield pd.DataFrame({"doc_id": [None], "n": [-1], "k1": [0], "k2": [0], "at": [at], "counts": [counts[at]]})

    # ids as text: pandas would round large ones next to a null
    schema = "doc_id string, n long, k1 long, k2 long, at array<long>, counts array<long>"
    named = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    return named.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def _levels(counted: DataFrame) -> np.ndarray:
    """How far each bucket stands out, a byte a bucket: 0 within four deviations of chance, then by quarter octaves.

    All orders start from this table, so that frequent tokens come last.
    """
    pairs = counted.where("n < 0").select(F.explode(F.arrays_zip("at", "counts")).alias("c"))
    sums = pairs.groupBy(F.col("c.at").alias("at")).agg(F.sum("c.counts").alias("total")).toPandas()  # a row a bucket
    counts = np.zeros(BUCKETS)
    counts[sums["at"].to_numpy(dtype=np.int64)] = sums["total"].to_numpy(dtype=np.float64)
    usual = np.median(counts)
    beyond = (counts - usual) / (4 * np.sqrt(usual + 1))
    return np.where(beyond < 1, 0, 1 + np.floor(4 * np.log2(np.maximum(beyond, 1)))).astype(np.uint8)


def _node(key: tuple[int, int], shared: frozenset[int]) -> int:
    return key[1] if key[0] in shared else key[0]


def _prefixes(docs: DataFrame, shingle: int, percent: int, levels: np.ndarray, shared: frozenset[int]) -> DataFrame:
    """(node, n, p0, p1 .., parity): the prefixes of each set; ``p0`` in order, the others as distinct 32-bit hashes;
    and the parity sketch. A node whose copies meet in one task is given out once."""
    table = docs.sparkSession.sparkContext.broadcast(levels)

    def first(tokens: np.ndarray, k: int, level: np.ndarray) -> np.ndarray:
        rank = (level << np.uint64(56)) | (_mixed(tokens, k + 1) >> np.uint64(8))
        length = prefix_length(len(tokens), percent)
        at = np.argpartition(rank, length - 1)[:length]
        if k:
            return np.unique(tokens[at].astype(np.uint32)).view(np.int32)
        return tokens[at[np.argsort(rank[at])]].view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels, seen = table.value.astype(np.uint64), set()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                tokens = tokens_of(text, shingle)
                node = _node(_keys(tokens), shared)
                if not len(tokens) or node in seen:
                    continue
                seen = seen if len(seen) < REMEMBERED else set()
                seen.add(node)
                level = levels[_bucket(tokens)]
                rows.append((node, len(tokens), *(first(tokens, k, level) for k in range(ORDERS)), _parity(tokens)))
            yield pd.DataFrame(rows, columns=["node", "n", *(f"p{k}" for k in range(ORDERS)), "parity"])

    further = "".join(f", p{k} array<int>" for k in range(1, ORDERS))
    return docs.select("text").mapInPandas(run, f"node long, n int, p0 array<long>{further}, parity binary")


def _filter_words(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``hash``, as 64-bit words; the bits of a hash are its probes.

    At most MOST_FILTER_WORDS words come to the driver; with many more hashes than bits it lets more pass.
    """
    words, many = 64, hashes.count()
    while words < MOST_FILTER_WORDS and words * 4 < many:
        words *= 2
    one = F.lit(1).cast("long")
    probes = F.array(
        *(
            F.struct(
                F.pmod(F.shiftright("hash", place), F.lit(words)).alias("at"),
                F.call_function("shiftleft", one, F.shiftright("hash", bit).bitwiseAND(63).cast("int")).alias("mask"),
            )
            for place, bit in PROBES
        )
    )
    found = hashes.select(F.inline(probes)).groupBy("at").agg(F.bit_or("mask").alias("mask")).toPandas()
    filled = np.zeros(words, dtype=np.int64)
    filled[found["at"].to_numpy(dtype=np.int64)] = found["mask"].to_numpy(dtype=np.int64)
    return filled.view(np.uint64)


def _passing(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    ok = np.ones(len(hashes), dtype=bool)
    for place, bit in PROBES:
        word = filled[(hashes >> place) % len(filled)]
        ok &= (word >> ((hashes >> bit) & 63).astype(np.uint64)) & np.uint64(1) == 1
    return ok


def _doc_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"))


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int, shared: frozenset[int]) -> DataFrame:
    """(node, tokens): the whole set of the first document of each node (node, doc_id).

    The few documents more that pass the filter, or repeat a doc_id, may give a node twice or one not asked for.
    """
    table = docs.sparkSession.sparkContext.broadcast(_filter_words(nodes.select(_doc_hash().alias("hash"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for text in batch["text"][_passing(table.value, batch["hash"].to_numpy(dtype=np.int64))]:
                tokens = tokens_of(text, shingle)
                node = _node(_keys(tokens), shared)
                if len(tokens) and node not in seen:
                    seen = seen if len(seen) < REMEMBERED else set()
                    seen.add(node)
                    rows.append((node, tokens.tobytes()))
            yield pd.DataFrame(rows, columns=["node", "tokens"])

    return docs.select("text", _doc_hash().alias("hash")).mapInPandas(run, "node long, tokens binary")


def _parity(tokens: np.ndarray) -> bytes:
    """A bit for each of at least as many places as tokens: whether an odd number of tokens falls there."""
    places = max(64, 1 << (len(tokens) - 1).bit_length())
    at = (_mixed(tokens, ORDERS + 1) % np.uint64(places)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=places) & 1, bitorder="little").tobytes()


def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    """Differing bits of two parity sketches; the longer one is folded to the length of the other."""

    def differing(x: bytes, y: bytes) -> int:
        x, y = sorted((x, y), key=len)
        while len(y) > len(x):
            half = len(y) // 2
            y = (int.from_bytes(y[:half]) ^ int.from_bytes(y[half:])).to_bytes(half)
        return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()

    return pd.Series([differing(x, y) for x, y in zip(a, b)], dtype="int64")


def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    def common(x: bytes, y: bytes) -> int:
        both = np.concatenate((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)))
        both.sort()
        return int((both[1:] == both[:-1]).sum())

    return pd.Series([common(x, y) for x, y in zip(a, b)], dtype="int64")


def _alike(smaller: Column, larger: Column, percent: int) -> Column:
    return smaller * 100 >= larger * percent


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("src").alias("node")).union(pairs.select(F.col("dst").alias("node"))).distinct()


def _judged(pairs: DataFrame, known: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, shared: frozenset[int], label: str) -> DataFrame:
    """The pairs (src, dst) that are alike: sketches differ little, prefixes of all orders share enough, then the
    whole sets are compared.

    Behind the prefix whose last token comes first in the order, its set has n - length tokens. So what two sets
    share is at most what their prefixes share, and that.
    """
    later = [f"p{k}" for k in range(1, ORDERS)]

    def end(side: str, other: str, columns: list[str], of: DataFrame = known) -> DataFrame:
        return of.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}{other}") for c in columns))

    both = pairs.join(end("src", "s", ["n", "parity"]), "src").join(end("dst", "d", ["n", "parity"]), "dst")
    both = both.where(_alike(F.least("ns", "nd"), F.greatest("ns", "nd"), percent))
    apart = F.pandas_udf(_apart, "long")("paritys", "parityd")
    both = both.select("src", "dst", "ns", "nd", apart.alias("apart"))
    both = both.where(F.col("apart") * (100 + percent) <= (F.col("ns") + F.col("nd")) * (100 - percent))
    near = written(both.select("src", "dst", "ns", "nd"), f"{label}-near")
    left = known.join(_ends(near), "node", "left_semi")
    both = near.join(end("src", "s", later, left), "src").join(end("dst", "d", later, left), "dst")
    behind = lambda n: F.expr(f"({percent} * {n} + 99) div 100 - 1")
    for p in later:
        # 32-bit hashes that fall together are counted as shared
        lost = F.col("ns") - behind("ns") - F.size(f"{p}s") + F.col("nd") - behind("nd") - F.size(f"{p}d")
        most = F.size(F.array_intersect(f"{p}s", f"{p}d")) + lost + F.greatest(behind("ns"), behind("nd"))
        both = both.where(most * (100 + percent) >= (F.col("ns") + F.col("nd")) * percent)
    kept = written(both.select("src", "dst", "ns", "nd"), f"{label}-kept")
    sets = written(_sets(docs, nodes.join(_ends(kept), "node", "left_semi"), shingle, shared), f"{label}-sets")
    left = sets.select(F.col("node").alias("src"), F.col("tokens").alias("ts"))
    right = sets.select(F.col("node").alias("dst"), F.col("tokens").alias("td"))
    common = F.pandas_udf(_overlap, "long")("ts", "td")
    both = kept.join(right, "dst").join(left, "src").select("src", "dst", "ns", "nd", common.alias("common"))
    alike = _alike(F.col("common"), F.col("ns") + F.col("nd") - F.col("common"), percent)
    return written(both.where(alike).select("src", "dst"), f"{label}-links")


def _prefix_lists(prefixes: DataFrame) -> DataFrame:
    """(tok, node, n, pos, held): the entries of tokens that several nodes hold; ``held`` is the length of the list.

    Both sides of the join read one shuffle of the entries.
    """
    packed = F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")
    entries = prefixes.select("node", "n", F.posexplode("p0").alias("pos", "tok")).select("tok", "node", packed.alias("place"))
    entries = entries.repartition("tok")
    held = entries.groupBy("tok").agg(
        F.min("node").alias("least"), F.max("node").alias("most"), F.count("place").alias("held")
    )
    lists = entries.join(held.where("least < most").select("tok", "held"), "tok")
    n, pos = F.shiftright("place", 32), F.col("place").bitwiseAND((1 << 32) - 1)
    return lists.select("tok", "node", n.alias("n"), pos.alias("pos"), "held")


def _star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each node of a long list with the head of the list, if their lengths allow a link."""
    long = lists.where(F.col("held") >= LONG_LIST)
    weight = long.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    long = long.join(weight, "node").select("tok", "node", "n", "weight")
    head = F.max(F.struct("weight", "node", "n")).alias("head")
    pairs = long.join(long.groupBy("tok").agg(head), "tok").where(F.col("node") != F.col("head.node"))
    pairs = pairs.where(_alike(F.least("n", "head.n"), F.greatest("n", "head.n"), percent))
    return pairs.select(F.least("node", "head.node").alias("src"), F.greatest("node", "head.node").alias("dst")).distinct()


def _cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of nodes of different components that share a prefix token where it can still matter.

    The longer set meets the shorter one within the shorter one's index prefix; and behind the first token
    in common there must be enough tokens left on both sides.
    """
    index = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent) - 1e-6) + 1
    short = lists.where(F.col("pos") < index).select(
        "tok", F.col("comp").alias("cs"), F.col("node").alias("src"), F.col("n").alias("ns"), F.col("pos").alias("at_s")
    )
    long = lists.select(
        "tok", F.col("comp").alias("cd"), F.col("node").alias("dst"), F.col("n").alias("nd"), F.col("pos").alias("at_d")
    )
    larger = (F.col("nd") > F.col("ns")) | ((F.col("nd") == F.col("ns")) & (F.col("dst") > F.col("src")))
    most = F.least(F.col("ns") - F.col("at_s"), F.col("nd") - F.col("at_d"))
    enough = most * (100 + percent) >= (F.col("ns") + F.col("nd")) * percent
    fits = (F.col("cs") != F.col("cd")) & larger & _alike(F.col("ns"), F.col("nd"), percent) & enough
    met = short.join(long, "tok").where(fits)
    return met.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def links(docs: DataFrame, nodes: DataFrame, levels: np.ndarray, shared: frozenset[int], shingle: int, percent: int) -> DataFrame:
    """(src, dst): links of nodes, enough of them to join all nodes that are joined by links at all."""
    prefixes = written(_prefixes(docs, shingle, percent, levels, shared), "jaccard-prefixes")
    lists = written(_prefix_lists(prefixes), "jaccard-lists")
    later = [f"p{k}" for k in range(1, ORDERS)]
    known = prefixes.select("node", "n", *later, "parity").join(lists.select("node").distinct(), "node", "left_semi")
    known = written(known.dropDuplicates(["node"]), "jaccard-known")
    stars = written(_star_pairs(lists, percent), "jaccard-stars")
    given = (docs, nodes, shingle, percent, shared)
    first = _judged(stars, known, *given, "jaccard-first")
    named = components(first, "jaccard-near").select("node", F.col("root").alias("comp"))
    lists = lists.select("tok", "node", "n", "pos").join(named, "node", "left")
    lists = written(lists.withColumn("comp", F.coalesce("comp", "node")), "jaccard-named")
    spread = lists.groupBy("tok").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most")
    lists = lists.join(spread.select("tok"), "tok", "left_semi").dropDuplicates(["tok", "node"])
    lists = written(lists, "jaccard-open")
    pairs = written(_cross_pairs(lists, percent).join(stars, ["src", "dst"], "left_anti"), "jaccard-pairs")
    return first.union(_judged(pairs, known, *given, "jaccard-second"))


def similar_documents(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id reachable over links of ``percent`` likeness."""
    counted = written(_counted(docs, shingle), "jaccard-keys")
    members = counted.where("n >= 0").select("doc_id", "n", "k1", "k2")
    twice = members.groupBy("k1").agg(F.min("k2").alias("lo"), F.max("k2").alias("hi")).where("lo < hi")
    shared = frozenset(r.k1 for r in twice.select("k1").collect())  # by chance alone: a few in 10^10 documents
    node = F.when(F.col("k1").isin(list(shared)), F.col("k2")).otherwise(F.col("k1")) if shared else F.col("k1")
    members = members.select("doc_id", "n", node.alias("node"))
    nodes = written(members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "jaccard-nodes")
    found = links(docs, nodes, _levels(counted), shared, shingle, percent)
    roots = components(found, "jaccard-components")
    nodes = nodes.join(roots, "node", "left").select("node", F.col("doc_id").alias("least"), F.coalesce("root", "node").alias("root"))
    nodes = written(nodes, "jaccard-roots")
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(names, "root").select("node", "component_id")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return members.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
