import random
import re

import xxhash

from fairload.llm import simhash


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """Least id reachable over links of at most 3 bits."""
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def corpus(rng):
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 400))) for _ in range(30)]
    texts = list(base)
    for t in base:
        for _ in range(3):
            words = t.split()
            words[rng.randrange(len(words))] = rng.choice(["Zz", "Q", "été", ""])
            texts.append(" ".join(words))
    return texts + ["", "", "ÀÉ A\x0bb c d", "A B c"]


def test_fingerprints_and_groups_equal_brute_force(documents):
    texts = corpus(random.Random(3))
    docs = documents(list(enumerate(texts)))
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in rows.items()} == brute_groups(prints)


def test_every_distance_up_to_three_is_linked(spark):
    rng = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        values.add(x)
        for n in (1, 2, 3, 4):
            y = x
            for bit in rng.sample(range(64), n):
                y ^= 1 << bit
            values.add(y)
    values = sorted(values)
    found = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), 3).collect()
    wanted = {
        frozenset((signed(a), signed(b))) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3
    }
    assert len(found) == len(wanted) and {frozenset(r) for r in found} == wanted


def test_balls_are_not_broadcast(spark, tmp_path):
    values = [(k * 0x9E3779B97F4A7C15 + 1) % (1 << 63) for k in range(500)]
    spark.createDataFrame([(v,) for v in [*values, *(v ^ 5 for v in values)]], "fp long").write.parquet(f"{tmp_path}/fp")
    found = simhash.links(spark.read.parquet(f"{tmp_path}/fp"), 3)  # a small file, as the planner sees it
    assert found.count() == 500
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_one_of_each_group_stays(documents):
    texts = corpus(random.Random(4))
    docs = documents([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, None)])
    groups = brute_groups({i: brute_print(t) for i, t in enumerate(texts)})
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values()))


def test_edges(documents):
    rows = simhash.near_duplicates(documents([(None, None), (None, ""), (4, "a"), (4, "a")])).collect()
    assert sorted((r["doc_id"] or -1, r["fingerprint"] == "0" * 16, r["component_id"] or -1) for r in rows) == [
        (-1, True, -1), (-1, True, -1), (4, False, 4), (4, False, 4),
    ]
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.drop_near_duplicates(documents([])).count() == 0
    assert simhash.drop_near_duplicates(documents([(None, "x y z"), (None, "x y z")])).count() == 1


def test_components_on_a_long_path_and_a_star(spark):
    from fairload.llm.components import components

    pairs = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(1000, 1100)] + [(None, 3), (5, 5)]
    rows = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "src long, dst long"), "t").collect()}
    assert {rows[k] for k in range(100, 161)} == {100}
    assert {rows[k] for k in [7, *range(1000, 1100)]} == {7}
    assert rows[5] == 5 and len(rows) == 61 + 101 + 1
