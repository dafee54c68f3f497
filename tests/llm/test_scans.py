"""Decontamination, licenses and phrase fingerprints against plain versions."""

import hashlib
import random
from collections import Counter

import pytest

from fairload.llm import decontaminate as dc
from fairload.llm import licenses as li
from fairload.llm import lz_fingerprint as lz

VOCABULARY = [f"w{k}" for k in range(300)]


def brute_items(text, items):
    words = dc.WORD.findall((text or "").lower())
    out = {}
    for item_id, item in items:
        own = dc.WORD.findall((item or "").lower())
        k = min(dc.SHINGLE, len(own))
        if not own:
            continue
        grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        target = grams(own)
        best = 0.0
        for at in range(len(words) - len(own) + 1):
            window = grams(words[at : at + len(own)])
            best = max(best, sum((window & target).values()) / sum((window | target).values()))
        if best >= dc.SIMILARITY:
            out[item_id] = best
    return out


@pytest.fixture(scope="module")
def contaminated():
    rng = random.Random(2)
    words = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = [(k, " ".join(words(rng.randint(15, 90)))) for k in range(25)] + [(90, "two words"), (91, None), (92, "...")]
    rows = []
    for k in range(120):
        body = words(rng.randint(0, 300))
        if k % 2:
            item = dict(items[:25])[rng.randrange(25)].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                item[rng.randrange(len(item))] = rng.choice(VOCABULARY)
            cut = rng.choice([0, 0, 1, 3])
            at = rng.randrange(len(body) + 1)
            body[at:at] = item[cut:]
        rows.append((k, " ".join(body).upper() if k % 3 else ", ".join(body)))
    return rows + [(None, items[0][1]), (200, None), (201, ""), (202, "Two words!")], items


def test_findings_equal_brute_force(documents, spark, contaminated):
    rows, items = contaminated
    docs = documents(rows)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, lang string")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.find_items(docs, bench).collect()}
    wanted = {(i, k): s for i, t in rows for k, s in brute_items(t, items).items()}
    assert found == pytest.approx(wanted)
    assert len(wanted) > 30
    dirty = {i for i, _ in wanted}
    clean = dc.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, _ in rows if i not in dirty)


def test_blocks_of_items_give_the_same(documents, spark, contaminated, monkeypatch):
    rows, items = contaminated
    docs, bench = documents(rows), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(dc.find_items(docs, bench).select("doc_id", "item_id").collect(), key=str)
    monkeypatch.setattr(dc, "BLOCK_CHARS", 1000)
    assert len(list(dc.blocks_of(bench))) > 3
    assert sorted(dc.find_items(docs, bench).select("doc_id", "item_id").collect(), key=str) == whole


def test_decontamination_of_empty_tables(documents, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents([(1, "a b c")])
    assert dc.find_items(docs, none).count() == 0 and dc.drop_contaminated(docs, none).count() == 1
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.find_items(documents([]), bench).count() == 0


def brute_common(a, b):
    """Length of the longest common subsequence: no alignment can be longer."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for k, y in enumerate(b):
            row[k + 1] = before[k] + 1 if x == y else max(row[k], before[k + 1])
    return row[-1]


def test_alignment_is_in_order_and_near_the_longest():
    rng = random.Random(4)
    for _ in range(300):
        template = [rng.choice(VOCABULARY[:80]) for _ in range(rng.randint(1, 40))]
        text = [w for w in template if rng.random() > 0.1]
        for _ in range(rng.randint(0, 8)):
            text.insert(rng.randint(0, len(text)), rng.choice(VOCABULARY))
        pairs = li.align(text, template)
        assert all(text[a] == template[b] for a, b in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= brute_common(text, template)
    unique = [f"u{k}" for k in range(30)]
    text = unique[:10] + ["noise"] * 5 + unique[12:]
    assert len(li.align(text, unique)) == 28


def test_longest_increasing_run():
    assert li.in_order([(0, 3), (1, 1), (2, 2), (3, 0), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]
    assert li.in_order([]) == []


def test_licenses_found_in_texts(documents):
    noise = " ".join(VOCABULARY)
    mit = li.NOTICES["MIT"].replace("without limitation ", "").upper()
    rows = [
        (1, f"{noise} Released under the\nMIT License. {noise} Released under the MIT License."),
        (2, f"{noise} {mit} {noise}"),
        (3, noise),
        (4, None),
        (5, ""),
        (None, "Licensed under the Apache License, version 2.0"),
        (None, "Licensed under the Apache License, version 2.0"),
        (6, "the " * 50_000 + "Licensed under CC BY-NC 4.0."),
    ]
    found = [tuple(r) for r in li.scan_licenses(documents(rows)).collect()]
    n = len(VOCABULARY)
    assert sorted(f[:2] for f in found if f[0]) == [
        (1, "MIT-short"), (1, "MIT-short"), (2, "MIT"), (6, "CC-BY-NC-4.0-short"),
    ]
    assert {f[3:] for f in found if f[0] == 1} == {(n, n + 4), (2 * n + 5, 2 * n + 9)}
    assert [f[1] for f in found if f[0] is None] == ["Apache-2.0-short"] * 2
    assert li.scan_licenses(documents([])).count() == 0


def brute_phrases(text):
    out, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in out:
            out.add(phrase)
            phrase = ""
    return out


def brute_print(text):
    hashes = set()
    for phrase in brute_phrases(text):
        h = 0
        for c in phrase:
            h = ((h + ord(c) + 1) * lz.STEP) & lz.WORD
        hashes.add(h)
    return lz.printed(lz.signature(hashes))


def test_phrase_fingerprints_equal_brute_force(documents):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé漢😀") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(60)] + [None, "", "ab"]
    ids = rng.sample(range(10**17, 10**17 + 1000), len(texts))
    rows = list(zip(ids, texts))
    rows.append((rows[0][0], rows[0][1]))
    found = sorted(lz.edited_pairs(documents(rows)).collect(), key=lambda r: -r["doc_id"])
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    assert [r["doc_id"] for r in found] == [i for i, _ in order]
    likeness = lambda a, b: sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / lz.SLOTS
    for k, (r, (_, text)) in enumerate(zip(found, order)):
        following = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == brute_print(text) and r["edited_fingerprint"] == brute_print(edited)
        assert r["near_edited"] == likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == likeness(r["fingerprint"], brute_print(following))


def test_phrase_fingerprint_edges(documents):
    (row,) = lz.edited_pairs(documents([(1, "abcabc")])).collect()
    assert row["near_next"] == 1.0  # an only document is followed by itself
    rows = lz.edited_pairs(documents([(None, "abc"), (2, "abd"), (None, None)])).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 0, 2]
    assert lz.edited_pairs(documents([])).count() == 0


def test_likeness_follows_shared_phrases():
    rng = random.Random(8)
    text = lambda seed: "".join(random.Random(seed).choice("abcdefghij ") for _ in range(3000))
    a = text(rng.random())
    signature = lambda t: lz.signature({hash(p) & lz.WORD for p in brute_phrases(t)})
    share = len(brute_phrases(a) & brute_phrases(a[:1500] + text(5)[1500:]))
    union = len(brute_phrases(a) | brute_phrases(a[:1500] + text(5)[1500:]))
    got = lz.likeness(signature(a), signature(a[:1500] + text(5)[1500:]))
    assert abs(got - share / union) < 0.2


def test_documents_shorter_than_the_item(documents, spark):
    rng = random.Random(12)
    items = [(k, [rng.choice(VOCABULARY) for _ in range(n)]) for k, n in enumerate((30, 60, 60, 90))]
    rows = []
    for k, words in items:
        for left in (1, 3, 6, 12, 25):
            rows += [(len(rows), words[:-left]), (len(rows) + 1, words[left:])]
            changed = list(words[: -(left + 1) // 2])
            changed[len(changed) // 2] = "other"
            rows.append((len(rows), changed))
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    wanted = {}
    for i, text in rows:
        for k, words in items:
            if len(text) < len(words):
                a, b = grams(text), grams(words)
                if (alike := sum((a & b).values()) / sum((a | b).values())) >= dc.SIMILARITY:
                    wanted[i, k] = alike
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    found = {(r[0], r[1]): r[2] for r in dc.find_items(documents([(i, " ".join(t)) for i, t in rows]), bench).collect()}
    assert found == pytest.approx(wanted) and len(wanted) > 20


def find_one(item, text):
    hashes = dc.WordHashes()
    return {k: v[0] for k, v in dc.Index([(1, " ".join(item))]).find(hashes.of(" ".join(text))).items()}


def test_similarity_of_exactly_the_bound_is_found():
    item = [f"i{k}" for k in range(67)]  # 63 shingles
    assert find_one(item, item[:60] + [f"o{k}" for k in range(7)]) == {0: 0.8}


def test_a_heavy_shingle_does_not_hide_an_item():
    rng = random.Random(1)
    for k in range(30):
        unique = [f"u{k}x{rng.randrange(10**9)}" for _ in range(76)]
        item, text = unique + [f"a{k}"] * 14, unique + [f"b{k}"] * 14
        # 72 shingles alike, of 86 and 86: not enough; 5 words fewer are
        assert find_one(item, text) == {}
        item, text = unique + [f"a{k}"] * 9, unique + [f"b{k}"] * 9
        assert find_one(item, text) == {0: 72 / 90}


def licenses_of(text):
    return [f.license for f in li.Templates(li.NOTICES).scan(li.words_of(text), li.COVERAGE)]


def test_one_license_a_stretch():
    assert licenses_of("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0-short"]
    assert licenses_of("Licensed under CC BY 4.0.") == ["CC-BY-4.0-short"]
    assert licenses_of("Licensed under CC BY-SA 4.0.") == ["CC-BY-SA-4.0-short"]
    for other in ("CC BY-ND 4.0", "CC BY-NC-ND 4.0", "CC BY 3.0", "the Apache License, Version 1.1"):
        assert licenses_of(f"Licensed under {other}.") == []
    assert licenses_of("This work is licensed under the GNU General Public License, version 2.") == []
    assert licenses_of("This work is licensed under the GNU General Public License, version 3.0.") == ["GPL-3.0-short"]
    assert licenses_of(li.NOTICES["Apache-2.0"]) == ["Apache-2.0"]  # the short notice stands in the long one


def test_unrelated_long_texts_are_not_alike():
    rng = random.Random(9)
    one, two = ({rng.getrandbits(64) for _ in range(100_000)} for _ in range(2))
    half = set(sorted(one)[:50_000]) | set(sorted(two)[:50_000])
    share = len(one & half) / len(one | half)
    assert lz.likeness(lz.signature(one), lz.signature(two)) < 0.05
    assert abs(lz.likeness(lz.signature(one), lz.signature(half)) - share) < 0.2
