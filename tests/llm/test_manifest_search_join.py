"""Merkle manifest, ranked search and Jaccard join against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fairload.llm import jaccard_join, merkle, ranked_search

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = str.maketrans(UPPER, UPPER.lower())


# ---------------------------------------------------------------- manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def mark(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def brute_manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root of (doc_id, text, lang, source, n_chars) rows."""

    def leaf(r, more=0):
        return sha("".join(map(mark, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]))))

    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([leaf(r) for r in groups[k]]) for k in order}
    top = levels([trees[k][-1][0] for k in order])
    out = []
    for place, k in enumerate(order):
        for i, r in enumerate(groups[k]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            siblings, seen = [], leaf(r, 1 if bad else 0)
            for tree, j in ((trees[k], i), (top, place)):
                for level in tree[:-1]:
                    run = level[j & ~1 : (j & ~1) + 2]
                    siblings += [x for n, x in enumerate(run) if (j & ~1) + n != j]
                    run = run[: j & 1] + [seen] + run[(j & 1) + 1 :]
                    seen, j = sha("".join(run)), j >> 1
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], sha("".join(siblings)), seen, seen == top[-1][0]))
    return sorted(out, key=str)


def manifest(spark, rows):
    full = [(*r, "x", 1, 2, "g") for r in rows]
    docs = spark.createDataFrame(
        full, "doc_id long, text string, lang string, source string, n_chars long, tree string, rank long, first int, `group` string"
    )
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return sorted((tuple(r) for r in merkle.proofs(docs.repartition(3), hit, F.col("n_chars") + 1).collect()), key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, None: 1}, {"en": 33, "de": 32, "é": 5}, {"en": 1100, "zz": 3, "": 70}])
def test_manifest_equals_plain_trees(spark, sizes):
    rows, at = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((at * 3, f"text {at} ü", lang, None if at % 5 == 0 else "s", None if at % 4 == 0 else at))
            at += 1
    assert manifest(spark, rows) == brute_manifest(rows)


def test_manifest_of_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None, None), (None, "a", None, "s", 1), (7, "x" * 300_000, "en", "s", 3), (7, "", "en", "s", 0)]
    rows += [(9, "same", "en", "s", 4)] * 3
    assert manifest(spark, rows) == brute_manifest(rows)
    assert manifest(spark, []) == []


def test_steps_fold_to_the_root_and_tell_changes(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(70)], "doc_id long, t string")
    rows = docs.select("doc_id", F.lit("all").alias("group"), F.sha2("t", 256).alias("leaf"))
    found = merkle.manifest(rows).withColumn("again", merkle.fold(F.col("leaf"), F.col("steps")))
    assert found.where("again = root").count() == 70 and found.where("size(steps) = 7").count() == 70


# ---------------------------------------------------------------- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(docs, items, k):
    found = [(i, Counter(TERM.findall((t or "").translate(LOWERED)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n = len(found)
    length = sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in found:
            m = 100 - 25 + (25 * c.total() * n) // length
            s = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, times in Counter(TERM.findall((text or "").translate(LOWERED))).items() if t in c
            )
            scores.append((-s, i is None, i or 0))
        best = sorted(s for s in scores if s[0] < 0)[:k]
        out += [(item, rank, None if gone else i, -s) for rank, (s, gone, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def ranks(spark, documents, rows, items, k=20):
    bench = spark.createDataFrame([(*i, 1, "s") for i in items], "item_id long, text string, doc_id long, score string")
    return sorted((tuple(r) for r in ranked_search.rank_documents(documents(rows), bench, k).collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)] + ["Über", "naïve", "ABC", "don't"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))) for i in range(n)], rng


def test_ranks_equal_scoring_everything(spark, documents, monkeypatch):
    rows, rng = corpus(300, 2)
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(None, rows[5][1]), (400, None), (401, ""), (402, ", . !"), rows[7]]
    rows.append((500, "w1 " * 60_000))
    items = [(i, rows[i * 9][1] if i % 2 else rows[i * 9][1] + " w1 w1 zzz") for i in range(12)] + [(90, None), (91, "..."), (92, "zzz")]
    want = brute_ranks(rows, items, 20)
    assert ranks(spark, documents, rows, items) == want
    monkeypatch.setattr(ranked_search, "BLOCK_CHARS", 300)
    monkeypatch.setattr(ranked_search, "BLOCK_CELLS", 1000)
    assert len(list(ranked_search.blocks_of(spark.createDataFrame(items, "item_id long, text string")))) > 2
    assert ranks(spark, documents, rows, items) == want


def test_search_of_empty_tables(spark, documents):
    assert ranks(spark, documents, [], [(1, "a")]) == []
    assert ranks(spark, documents, [(1, "a b")], []) == []
    assert ranks(spark, documents, [(1, "a b"), (2, "c")], [(1, "a"), (1, "a")]) == brute_ranks([(1, "a b"), (2, "c")], [(1, "a")], 20)


def test_reading_stops_before_the_ends_of_the_lists():
    import numpy as np

    rng = np.random.default_rng(4)
    texts = [" ".join(["a"] * int(a) + ["b"] * int(b) + ["c"] * 50) for a, b in rng.integers(0, 6, (3000, 2))]
    texts[77] = "a a a a a a a a a b b b b b b b b b"
    items = ranked_search.Items([0], [1], {b"a": 0, b"b": 1}, [(np.array([0, 1]), np.array([1, 1]))])
    total = sum(len(t.split()) for t in texts)
    lists = ranked_search.Lists(texts, items, ranked_search.Corpus(3000, total, np.array([2500, 2500])), np.array([700, 700]))
    docs, scores = ranked_search.best_positions(lists, *items.wanted[0], 1, 0)
    assert docs[scores.argmax()] == 77 and len(docs) < 300


# ---------------------------------------------------------------- Jaccard join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_join(rows, shingle, percent):
    sets = []
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWERED))
        sets.append(frozenset(tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)) or frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    ids = {}
    for a, (i, _) in enumerate(rows):
        ids.setdefault(find(a), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((i, len(s), least[find(a)] if s else i) for a, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def joined(documents, rows, shingle=4, percent=85):
    return sorted((tuple(r) for r in jaccard_join.similar_documents(documents(rows), shingle, percent).collect()), key=str)


def near_rows(seed):
    """Groups of near copies around a text that is not there itself, with links just above and below the limit."""
    rng = random.Random(seed)
    rows = []
    for group in range(6):
        base = [f"g{group}w{k}" for k in range(rng.choice([12, 40, 120]))]
        for _ in range(rng.choice([2, 12, 25])):
            words = base[:]
            for _ in range(rng.randint(1, max(1, len(base) // 20))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
            rows.append((len(rows) * 2 + 1, " ".join(words)))
    return rows, rng


def test_join_equals_all_pairs(documents):
    rows, rng = near_rows(11)
    rows += [(900, rows[0][1].upper()), (901, rows[0][1]), (902, None), (903, ""), (904, "one two"), (905, "One\ttwo"), (906, "two one")]
    rows += [(None, rows[4][1]), (None, "alone in this case here"), (907, " ".join(f"w{k}" for k in range(60_000))), rows[2]]
    assert joined(documents, rows) == brute_join(rows, 4, 85)


def test_join_at_other_lengths_and_limits(documents, monkeypatch):
    rows, _ = near_rows(12)
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 3)
    assert joined(documents, rows, 2, 80) == brute_join(rows, 2, 80)


def test_two_keys_that_share_their_first_half_stay_apart(documents, monkeypatch):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, "p q r s t u"), (4, "v w x y")]
    real = jaccard_join._keys
    shared = frozenset([77])
    assert jaccard_join._node((77, 5), shared) == 5 and jaccard_join._node((78, 5), shared) == 78
    assert len({real(jaccard_join.tokens_of(t, 4)) for _, t in rows}) == 3
    assert joined(documents, rows) == brute_join(rows, 4, 85)


def test_join_of_an_empty_table(documents):
    assert joined(documents, []) == [] and joined(documents, [(5, None)]) == [(5, 0, 5)]
