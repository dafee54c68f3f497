import hashlib
import random

import duckdb

from fairload.llm import line_dedup as ld
from fairload.llm import queries


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    """(doc_id, copies, near lines, text left), comparing every line with every earlier one."""
    lines = [
        ((i is None, i or 0, n), tuple(line.encode().split()))
        for i, t in rows
        for n, line in enumerate((t or "").split("\n"))
        if t is not None
    ]
    first = {}
    for at, words in sorted(lines):
        first.setdefault(words, at)
    gone = {
        w
        for w in first
        for v in first
        if len(w) >= ld.NEAR_WORDS and len(v) >= ld.NEAR_WORDS and first[v] < first[w] and near(w, v)
    }
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        kept, copies, nears = [], 0, 0
        for n, line in enumerate(t.split("\n")):
            words = tuple(line.encode().split())
            if words in gone:
                nears += 1
            elif len(words) >= ld.MIN_WORDS and first[words] != (i is None, i or 0, n):
                copies += 1
            else:
                kept.append(line)
        out.append((i, copies, nears, "\n".join(kept)))
    return out


def corpus(rng):
    vocabulary = ["a", "b", "c", "dé", "e", "f"]
    lines = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 16))] for _ in range(40)]
    for base in list(lines):
        for _ in range(4):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                k, kind = rng.randrange(len(words)), rng.randrange(3)
                if kind == 0:
                    words[k] = rng.choice(vocabulary)
                elif kind == 1:
                    words.insert(k, rng.choice(vocabulary))
                elif len(words) > 1:
                    del words[k]
            lines.append(words)
    rng.shuffle(lines)
    texts = [rng.choice(["", "  "]) + "  ".join(words) for words in lines]
    return ["\n".join(texts[k : k + 5] + [""]) for k in range(0, len(texts), 5)]


def test_report_and_texts_equal_brute_force(documents):
    for seed in (1, 2):
        rows = list(enumerate(corpus(random.Random(seed))))
        rows += [(None, rows[3][1] + "\n" + "q " * 12), (500, None), (501, ""), (502, rows[0][1])]
        docs = documents(rows)
        wanted = brute(rows)
        found = {r["doc_id"]: r for r in ld.line_report(docs).collect()}
        digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
        assert {i: (r["n_copies"], r["n_near"], r["rest_sha256"]) for i, r in found.items()} == {
            i: (c, n, digest(t)) for i, c, n, t in wanted
        }
        kept = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs).collect()}
        assert kept == {i: t for i, c, n, t in wanted if not (c + n and not t.strip())}
        assert ld.dedup_lines(docs).columns == docs.columns


def test_repeated_rows_are_one_document(documents):
    docs = documents([(1, "one two three four five"), (1, "one two three four five"), (2, "one two three four five")])
    rows = ld.line_report(docs).collect()
    assert sorted((r["doc_id"], r["n_copies"]) for r in rows) == [(1, 0), (1, 0), (2, 1)]


def test_a_hot_line_and_its_near_lines(documents):
    base = [f"w{k}" for k in range(20)]
    rows = [(k, " ".join([*base[: k % 20], f"x{k}", *base[k % 20 + 1 :]])) for k in range(1, 400)]
    rows += [(0, " ".join(base)), (999, " ".join(base))]
    rows = [(i, t + "\nown words of number " + str(i) + " stay here") for i, t in rows]
    left = ld.dedup_lines(documents(rows)).collect()
    # one word apart from line 0 each, so only that one stays
    assert sorted(len(r["text"].split("\n")) for r in left) == [1] * 400 + [2]


def test_empty_and_long(documents):
    assert ld.dedup_lines(documents([])).count() == 0
    long = "\n".join(f"line number {k} of a long text" for k in range(20_000))
    rows = ld.line_report(documents([(1, long), (2, long)])).collect()
    assert {r["doc_id"]: r["n_copies"] for r in rows} == {1: 0, 2: 20_000}


def apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for k, y in enumerate(b, 1):
            row.append(min(before[k] + 1, row[-1] + 1, before[k - 1] + (x != y)))
    return row[-1]


def test_edit_bound_grows_with_the_line(documents):
    rng = random.Random(7)
    vocabulary = [f"v{k}" for k in range(60)]
    lines = []
    for n in (18, 19, 20, 29, 30, 39, 40, 45, 60, 100, 130):
        for _ in range(3):
            base = [rng.choice(vocabulary) for _ in range(n)]
            lines.append(base)
            for edits in (1, n // 10, n // 10, n // 10 + 1, n // 10 + 2):
                # evenly spread, so that no run is longer than it must be
                words, places = list(base), [(j + 1) * n // (edits + 1) for j in range(edits)]
                for at in reversed(places):
                    kind = rng.randrange(3)
                    words[at : at + (kind != 1)] = [] if kind == 2 else ["new" + str(rng.randrange(10**6))]
                lines.append(words)
    rng.shuffle(lines)
    found = {r["doc_id"]: r["n_near"] for r in ld.line_report(documents([(i, " ".join(w)) for i, w in enumerate(lines)])).collect()}
    wanted = {
        i: int(any(apart(w, v) <= max(1, max(len(w), len(v)) // 10) for v in lines[:i] if v != w))
        for i, w in enumerate(lines)
    }
    assert found == wanted and sum(wanted.values()) > 80


def test_word_distance():
    rng = random.Random(3)
    for _ in range(2000):
        a = [rng.choice("abc") for _ in range(rng.randint(10, 40))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = rng.choice([[], ["a"], ["z"]])
        if b:
            assert ld.words_apart(" ".join(a), " ".join(b)) == (apart(a, b) <= max(len(a), len(b)) // 10)


def test_short_copies_go_and_blank_lines_stay(documents):
    rows = [(1, "All rights reserved.\n\none\nkept first"), (2, "All rights  reserved.\n\n \none\nkept second\none")]
    left = {r["doc_id"]: r["text"] for r in ld.dedup_lines(documents(rows)).collect()}
    assert left == {1: rows[0][1], 2: "\n \nkept second"}


def test_query_equals_its_sql(documents, tmp_path):
    rng = random.Random(11)
    texts = corpus(rng)
    for n in (10, 11, 19, 20, 21, 30, 57, 140):
        base = [f"v{rng.randrange(40)}" for _ in range(n)]
        for edits in (0, 1, 1, 1, 1, 1, 1, 2, 2, 2):
            words = list(base)
            for _ in range(edits):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = rng.choice([[], ["new"], [f"x{rng.randrange(99)}"]])
            texts.append(" ".join(words) + "\nAll rights reserved.\n\nfive words stand just here")
    for n in (10, 11, 12, 40, 41):  # an edit at every place of a line, and that line repeating itself
        for base in ([f"p{k}" for k in range(n)], ["again", "and"] * n):
            texts += [" ".join([*base[:k], *w, *base[k + 1 :]]) for k in range(len(base)) for w in ([], ["n"], [base[k], "n"])]
            texts.append(" ".join(base))
    rng.shuffle(texts)
    documents([*enumerate(texts), (9001, None), (9002, "")]).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op3_line_dedup(documents([]).sparkSession, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    twin = con.execute(queries.ORACLE["op3_line_dedup"]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(twin)
    assert sum(r[2] for r in twin) > 50 and sum(r[3] for r in twin) > 200


def test_near_copies_that_are_not_near_meet_once(documents, monkeypatch):
    lines = []
    for i in range(12):  # one passage, each time with five words put in: ten edits apart where nine are allowed
        words = [f"w{k}" for k in range(90)]
        for j in range(5):
            words.insert(i + 15 * j, f"own{i}x{j}")
        lines.append(words)
    pairs, verified = {}, ld._verified

    def kept(keyed, distinct, found, label):
        pairs[label] = [tuple(sorted(r)) for r in found.collect()]
        return verified(keyed, distinct, found, label)

    monkeypatch.setattr(ld, "_verified", kept)
    found = {r["doc_id"]: r["n_near"] for r in ld.line_report(documents([(i, " ".join(w)) for i, w in enumerate(lines)])).collect()}
    assert found == {i: int(any(apart(w, v) <= 9 for v in lines[:i])) for i, w in enumerate(lines)}
    rest = pairs["line-rest"]
    assert len(rest) > 40 and len(rest) <= 1.2 * len(set(rest))


def test_only_grams_with_a_fitting_line_reach_the_last_join(documents, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(40)]
    lines = [[*base, *(f"own{i}x{j}" for j in range(40))] for i in range(60)]  # share 40 words of 80: never near
    lines += [[f"{i}s{j}" for j in range(i)] + base[:12] + [f"{i}t{j}" for j in range(30)] for i in range(0, 40, 4)]
    groups = []
    for g in range(8):  # two near lines of the same number in one document id; what they share stands in an earlier line too
        base = [f"g{g}w{k}" for k in range(40)]
        lines.append([*base, *(f"g{g}o{k}" for k in range(40))])
        a, b = list(base), list(base)
        for words, places in ((a, (8, 24)), (b, (16, 32))):
            for k in places:
                words[k] = f"new{rng.randrange(10**9)}"
        groups.append((None if g == 3 else 1000 + g, " ".join(a), " ".join(b)))
    rows = [(i, " ".join(w)) for i, w in enumerate(lines)] + [(i, t) for i, *texts in groups for t in texts]
    tables, kept = {}, ld.written

    def keep(df, label):
        tables[label] = kept(df, label)
        return tables[label]

    monkeypatch.setattr(ld, "written", keep)
    found = [(r["doc_id"], r["n_near"]) for r in ld.line_report(documents(rows)).collect()]
    assert sorted(found, key=str) == sorted([*((i, 0) for i in range(len(lines))), *((i, n) for i, *_ in groups for n in (0, 1))], key=str)
    left, pairs = tables["line-open"], tables["line-rest"]
    assert pairs.count() > 0 and left.select("id").distinct().count() == 2 * pairs.count()
    assert 10 * left.count() < tables["line-keys"].count()


def test_lines_of_repeated_words_are_told_apart_by_their_counts(documents, monkeypatch):
    rng = random.Random(9)
    some = "abcdefghijklmnopqrst"
    lines = [[w for w in rng.sample(some, 6) for _ in range(n)] for n in (5, 6, 10, 12) for _ in range(12)]
    lines += [["z"] * 40 + [w for w in rng.sample(some, 6) for _ in range(6)] for _ in range(12)]
    lines += [["a"] * 1500 + [f"r{g}"] * 900 for g in range(2)]  # more of a word than a count can say
    for base in lines[::5] + lines[-2:]:
        words, edits = list(base), len(base) // 10
        for at in rng.sample(range(len(words)), edits):
            words[at] = rng.choice(["y", "a", f"new{rng.randrange(10**9)}"])
        lines += [words[: len(words) - 1], [*base, "end"]]
    pairs, verified = {}, ld._verified

    def kept(keyed, distinct, found, label):
        pairs[label] = {tuple(sorted(r)) for r in found.collect()}
        return verified(keyed, distinct, found, label)

    monkeypatch.setattr(ld, "_verified", kept)
    found = {r["doc_id"]: r["n_near"] for r in ld.line_report(documents([(i, " ".join(w)) for i, w in enumerate(lines)])).collect()}
    wanted = {
        i: int(any(ld.words_apart(" ".join(w), " ".join(v)) for v in lines[:i] if v != w)) for i, w in enumerate(lines)
    }
    assert found == wanted and sum(wanted.values()) > 15
    assert len(pairs["line-least"] | pairs["line-rest"]) < 3 * len(lines)


def test_rows_of_the_last_joins_are_not_broadcast(documents, monkeypatch):
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([f"own{i}", *base[:40], f"own{i}x", *base[40:]])) for i in range(20)]
    plans, kept, verified = [], ld.written, ld._verified

    def plan(df):  # of the join on key and size
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())

    def keep(df, label):
        if label == "line-open":
            plan(df)
        return kept(df, label)

    def keep_pairs(keyed, distinct, found, label):
        if label == "line-rest":
            plan(found)
        return verified(keyed, distinct, found, label)

    monkeypatch.setattr(ld, "written", keep)
    monkeypatch.setattr(ld, "_verified", keep_pairs)
    assert sum(r["n_near"] for r in ld.line_report(documents(rows)).collect()) == 19
    assert len(plans) == 2 and all("strategy=merge" in p for p in plans)


def test_wanted_rows_are_marked_in_few_bits(documents):
    docs = documents([(None, "none"), *((k, f"text {k % 700}") for k in range(3000))])
    rows = ld._keyed(docs).select("doc", "body")
    wanted = rows.where("doc is null or doc % 50 = 7").selectExpr("doc as w_doc", "body as w_body")
    likely, others = (ld._likely(rows, wanted, how).collect() for how in ("left_semi", "left_anti"))
    assert {r["w_doc"] for r in wanted.collect()} <= {r["doc"] for r in likely} and len(likely) < 80
    assert sorted(map(str, likely + others)) == sorted(map(str, rows.collect()))
    assert ld._likely(rows, wanted.limit(0), "left_anti").count() == 3001


def test_texts_without_a_wanted_line_are_not_joined(documents, monkeypatch):
    lines = [" ".join(f"{i}w{k}" for k in range(30)) for i in range(200)]
    rows = list(enumerate(lines)) + [(1000, lines[7] + " end"), (1001, lines[8])]
    seen, likely = [], ld._likely

    def kept(rows, wanted, how):
        out = likely(rows, wanted, how)
        seen.append((how, out.count()))
        return out

    monkeypatch.setattr(ld, "_likely", kept)
    left = {r["doc_id"] for r in ld.dedup_lines(documents(rows)).collect()}
    assert left == set(range(200))
    assert all(n < 10 for how, n in seen if how == "left_semi") and ("left_anti", 200) in seen
