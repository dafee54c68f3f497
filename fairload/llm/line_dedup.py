"""Line dedup by a deletion-neighbourhood join.

A line is a sequence of words. Two lines are near if few words replaced, put in or left out turn one into the
other: one word, or a tenth of the words of the longer line, rounded down, if that is more.

``one_edit`` keeps the bound at one word for all lengths, as the SQL twin of the query states it:

* a line emits itself without each of its ``PIECES`` pieces in turn, once cut by its own length and once as the
  line without one word of a line one word longer. One edit lies in one piece, so near lines share such a key;
* only of a line that shares one the words are fetched, once, and of the pieces it shares each word is left out in
  turn: the keys described next for short lines, for a small part of the places.

Otherwise each line emits hashed keys, all lengths in one table (``keys``):

* a line of fewer than ``WIDE_WORDS`` words, whose bound is one, emits itself and its deletion variants: each
  word left out in turn, with the place of the missing word. Lines that share a variant with the word missing at
  the same place differ in that word only; a whole line that equals a variant is that line without one word. So
  the least line of each key suffices, and no pair of a group is written out;
* a longer line emits what k deletions must leave whole: k edits leave at most k + 1 runs, so some run of six
  words (seven from 30 words on, eight from 40, nine from 90) stands in both lines. Of the four-word grams in each
  window of that many words the one with the least hash is a key; a whole run has the same least gram in both lines.

Most keys occur in one line only. Keys are shuffled once, as bare numbers, sorted, and streamed past each other: a
task holds one batch and the last key, and only keys of two lines and more go on. What a map task already sees to
be shared is spread by line instead of by key, but for two witnesses, so that a frequent key makes no large group.

Sharing a gram does not make long lines near, so a least line a key is not enough for them:

* each line is first compared with the least lines of its grams. In a large group of near copies this finds
  an earlier near line for almost all;
* only lines for which none was found are joined with all earlier lines of their grams but the least, which is
  settled; a gram of two lines has no others. Lengths, places of the gram and
  the parities and counts of word hashes (an edit turns at most two bits) must fit before the words are compared. A gram that a
  line repeats is one row with its first and last place, so a line that says the same over and over joins once a gram.
  A semi-join of bare rows first keeps the grams in which a line meets a fitting one, a few of all.
  Near copies share many grams: of those that are left, a row carries the ``BEFORE`` ones before it, and two lines that
  meet in one of those do not meet again. All grams in which a pair meets are left and the first of them has none before
  it, so no pair is lost.

The edit distance of every candidate pair is verified on the words themselves.

What goes: every occurrence of a line but the first, and every line that has an earlier near line. "First" is
by doc_id, then line number. Blank lines stay; of any other line one occurrence is left. Lines
of fewer than ``NEAR_WORDS`` words are compared for equality only: one word of few is another statement.

Cases: a null text is kept as null and has no lines; blank lines stay; a null doc_id counts as the largest;
rows that repeat both doc_id and text count as one document and are treated alike; other columns stay as they
are, whatever their names; an empty table gives an empty result. Texts are read whole. A document all of
whose non-blank lines go is dropped from ``dedup_lines``; ``line_report`` still lists it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairload.llm.common import written

MIN_WORDS = 1
NEAR_WORDS = 10
PIECES = 4
SHORTER = 1 << PIECES  # bit of a line that may be one without a word; the lower bits name pieces of it
WIDE_WORDS = 20  # from here on a tenth of the words is more than one
WIDE_LEAST = WIDE_WORDS - WIDE_WORDS // 10  # shortest line beside one of WIDE_WORDS
GRAM = 4
WINDOWS = ((WIDE_LEAST, 3), (30, 4), (40, 5), (90, 6))  # from so many words on: grams in a window
BINS = 8  # of a line's words, counted in a byte each
SIGNATURE = ("b0", "b1", "counts")
LIKELY_BLOCKS, LIKELY_BITS = 512, 1 << 15  # blocks of so many bits that mark wanted rows: 2 MB for tables of any size
BEFORE = 16  # shared grams of a line that a row of the last join looks back on
LAST_DOC = (1 << 63) - 1  # stands for a null doc_id, which counts as the largest
SLAB = 1 << 19  # bytes of text handled at a time; a longer line is one slab
KNOWN_LINES = 300_000  # lines a task remembers having emitted before it starts anew

BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))  # odd, so they have inverses
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
WHOLE = -1  # tag of a whole line; deletion variants have the place, grams the place below GRAM_TAG
GRAM_TAG = -2


def mixed(values: np.ndarray, tag: np.ndarray | int = 0) -> np.ndarray:
    out = values ^ np.asarray(tag).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


class Rolling:
    """Hashes of stretches of a sequence in one step: sum(value[k] * base**k), k from 0 at the begin, modulo 2**64."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(values):
            row = np.ones(len(values) + len(values) // 4 + 2, dtype=np.uint64)
            row[1:] = self.base
            self.powers = np.cumprod(row)
            row[1:] = self.inverse
            self.inverses = np.cumprod(row)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.powers[: len(values)])])

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[begin]) * self.inverses[begin]


def slabs(texts: list[bytes | None]) -> Iterator[list[tuple[int, int, bytes]]]:
    """The texts in parts of about ``SLAB`` bytes, cut between lines: (row, number of the first line, lines)."""
    held, size = [], 0
    for row, text in enumerate(texts):
        at = number = 0
        while text is not None:
            end = text.find(b"\n", at + SLAB) if len(text) - at > SLAB else -1
            last = end < 0
            part = text[at:] if last else text[at:end]
            held.append((row, number, part))
            size += len(part)
            if size >= SLAB:
                yield held
                held, size = [], 0
            if last:
                break
            number += part.count(b"\n") + 1
            at = end + 1
    if held:
        yield held


class Lines:
    """The lines of a slab: row, number, first word and one past the last, and the hashes of all words."""

    def __init__(self, slab: list[tuple[int, int, bytes]], rolling: list[Rolling]) -> None:
        raw = np.frombuffer(b"\n".join(part for _, _, part in slab), dtype=np.uint8)
        edge = np.diff(np.concatenate([[True], BLANK[raw], [True]]).astype(np.int8))
        start, stop = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        codes = raw.astype(np.uint64) + np.uint64(1)
        self.words = [mixed(r.of(r.sums(codes), start, stop)) for r in rolling]
        self.sums = [r.sums(w) for r, w in zip(rolling, self.words)]
        breaks = np.nonzero(raw == 10)[0]
        begin = np.searchsorted(start, np.append(0, breaks + 1))
        end = np.append(begin[1:], len(start))
        counts = np.array([part.count(b"\n") + 1 for _, _, part in slab])
        row = np.repeat([r for r, _, _ in slab], counts)
        number = np.arange(len(row)) + np.repeat([n for _, n, _ in slab] - np.cumsum(counts) + counts, counts)
        chosen = end - begin >= MIN_WORDS
        self.row, self.number, self.begin, self.end = (x[chosen] for x in (row, number, begin, end))
        self.size = self.end - self.begin
        self.hashes = [mixed(r.of(s, self.begin, self.end), self.size) for r, s in zip(rolling, self.sums)]


def signatures(lines: Lines) -> np.ndarray:
    """For each line of ``WIDE_LEAST`` words and more 128 bits, each the parity of the number of its words with that hash,
    and ``BINS`` bytes, each the number of its words with that hash, 255 if there are more."""
    out = np.zeros((len(lines.size), 3), dtype=np.int64)
    wide = np.nonzero(lines.size >= WIDE_LEAST)[0]
    if len(wide):
        n = lines.size[wide]
        at = np.arange(n.sum()) + np.repeat(lines.begin[wide] - np.cumsum(n) + n, n)
        bin_of = np.repeat(np.arange(len(wide)) * 128, n) + (lines.words[0][at] >> np.uint64(57)).astype(np.int64)
        odd = np.bincount(bin_of, minlength=128 * len(wide)) & 1
        out[wide, :2] = np.packbits(odd.astype(np.uint8).reshape(-1, 128), axis=1).view(np.int64)
        bin_of = np.repeat(np.arange(len(wide)) * BINS, n) + (lines.words[0][at] >> np.uint64(49)).astype(np.int64) % BINS
        counts = np.minimum(np.bincount(bin_of, minlength=BINS * len(wide)), 255).astype(np.uint8)
        out[wide, 2] = counts.reshape(-1, BINS).view(np.int64)[:, 0]
    return out


BARE_LINE = "doc long, body long, line_no int, h1 long, h2 long, words int"
LINE = BARE_LINE + ", b0 long, b1 long, counts long"


def bare_line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines as ``line_rows`` gives them, without signatures."""
    return line_rows(batches, BARE_LINE)


def line_rows(batches: Iterator[pa.RecordBatch], schema: str = LINE) -> Iterator[pa.RecordBatch]:
    """The non-blank lines of (doc, body, text): two hashes, number of words, and signatures of long lines."""
    rolling = [Rolling(b) for b in BASES]
    for batch in batches:
        for slab in slabs(batch["text"].cast(pa.binary()).to_pylist()):
            lines = Lines(slab, rolling)
            bits, row = signatures(lines).T.copy() if schema == LINE else [], pa.array(lines.row)
            h1, h2 = (h.view(np.int64) for h in lines.hashes)
            number, size = lines.number.astype(np.int32), lines.size.astype(np.int32)
            columns = [batch["doc"].take(row), batch["body"].take(row), number, h1, h2, size, *bits]
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def pieces(lines: Lines, rolling: Rolling, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, line, bit, 0) of the chosen lines without each of their pieces, as they are and as one short of a word."""
    sums, own, last, n = lines.sums[0], lines.begin[chosen], lines.end[chosen], lines.size[chosen]
    keys, bits = [], []
    for short in range(2):
        for k in range(PIECES):
            low, high = k * (n + short) // PIECES, (k + 1) * (n + short) // PIECES - short
            back = (sums[last] - sums[own + high]) * rolling.inverses[high - low]
            bare = (sums[own + low] - sums[own] + back) * rolling.inverses[own]
            keys.append(mixed(bare, ((n + short) * PIECES + k) | 1 << 41))
            bits.append(np.full(len(chosen), SHORTER if short else 1 << k))
    return np.concatenate(keys), np.tile(chosen, 2 * PIECES), np.concatenate(bits), np.zeros(len(chosen) * 2 * PIECES, int)


def variants(lines: Lines, rolling: Rolling, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, line, tag, 0) of the chosen lines themselves and of each with each of its words left out in turn."""
    n, begin, end = lines.size[chosen], lines.begin[chosen], lines.end[chosen]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own, sums = np.repeat(begin, n), lines.sums[0]
    at, last = own + place, np.repeat(end, n)
    back = (sums[last] - sums[at + 1]) * rolling.inverses[1]
    keys = mixed((sums[at] - sums[own] + back) * rolling.inverses[own], np.repeat(n - 1, n))
    return (
        np.concatenate([lines.hashes[0][chosen], keys]),
        np.concatenate([chosen, np.repeat(chosen, n)]),
        np.concatenate([np.full(len(chosen), WHOLE), place]),
        np.zeros(len(chosen) + len(place), dtype=np.int64),
    )


def least_grams(lines: Lines, rolling: Rolling, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, line, tag, reach) of the grams that are least in a window of a chosen line. The tag names the first such
    place of the gram in the line, the reach is how far the last one lies behind it."""
    sums = lines.sums[0]
    at = np.arange(max(len(sums) - GRAM, 0))
    keys = mixed(rolling.of(sums, at, at + GRAM), 1 << 40)
    owner = np.full(len(sums) - 1, -1)
    n = lines.size[chosen]
    inside = np.arange(n.sum()) + np.repeat(lines.begin[chosen] - np.cumsum(n) + n, n)
    owner[inside] = np.repeat(chosen, n)
    taken = np.zeros(len(keys), dtype=bool)
    for (least, span), after in zip(WINDOWS, [*(x for x, _ in WINDOWS[1:]), np.inf]):
        windows = len(keys) - span + 1
        if windows < 1:
            continue
        smallest = keys[:windows].copy()
        for k in range(1, span):
            np.minimum(smallest, keys[k : k + windows], out=smallest)
        first = owner[:windows]
        size = np.where(first >= 0, lines.size[first], 0)
        good = (size >= least) & (size < after) & (np.arange(windows) + span + GRAM - 1 <= lines.end[first])
        for k in range(span):
            taken[k : k + windows] |= good & (keys[k : k + windows] == smallest)
    at = np.nonzero(taken)[0]
    at = at[np.lexsort((at, owner[at], keys[at]))]
    key, line = keys[at], owner[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    first, last = at[new], at[np.append(new[1:], True)[: len(at)]]
    return key[new], line[new], GRAM_TAG - (first - lines.begin[line[new]]), last - first


KEY = "key long, id long, tag int, spread int, reach int"


def piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the lines of (text) without a piece, the bit of it as tag; spread as in ``key_rows``."""
    return key_rows(batches, one_edit=True)


def key_rows(batches: Iterator[pa.RecordBatch], one_edit: bool = False) -> Iterator[pa.RecordBatch]:
    """Keys of the lines of (text). Rows of a key that two lines of a slab share get a number to spread them by,
    but for one row of the first and one of the last line, which go where all rows of the key meet."""
    rolling, known = [Rolling(BASES[0])], set()
    for batch in batches:
        for slab in slabs(batch["text"].cast(pa.binary()).to_pylist()):
            lines = Lines(slab, rolling)
            if not len(lines.size):
                continue
            if len(known) > KNOWN_LINES:
                known.clear()
            ids = lines.hashes[0].view(np.int64)
            unique, first = np.unique(ids, return_index=True)
            fresh = np.array([i not in known for i in unique.tolist()], dtype=bool)
            known.update(unique[fresh].tolist())
            chosen, size = first[fresh], lines.size[first[fresh]]
            if one_edit:
                key, line, tag, reach = pieces(lines, rolling[0], chosen[size >= NEAR_WORDS])
            else:
                near = chosen[(size >= NEAR_WORDS) & (size < WIDE_WORDS)]
                made = zip(variants(lines, rolling[0], near), least_grams(lines, rolling[0], chosen[size >= WIDE_LEAST]))
                key, line, tag, reach = (np.concatenate(x) for x in made)
            key, line, tag, reach = key.view(np.int64), ids[line], tag.astype(np.int32), reach.astype(np.int32)
            if not len(key):
                continue
            order = np.lexsort((line, key))
            key, line, tag, reach = (x[order] for x in (key, line, tag, reach))
            begin = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
            last = np.append(begin[1:], len(key)) - 1
            shared = np.repeat(line[begin] != line[last], last - begin + 1)
            shared[begin] = shared[last] = False
            spread = np.where(shared, 1 + (line & 0xFFF), 0).astype(np.int32)
            columns = [pa.array(x) for x in (key, line, tag, spread, reach)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in KEY.split(", ")])


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the lines (id, bits, line): the line without each word of the pieces named by its bits, and the whole
    line if it may be one without a word."""
    rolling = [Rolling(BASES[0])]
    for batch in batches:
        row_bits = batch["bits"].to_numpy()
        for slab in slabs(batch["line"].cast(pa.binary()).to_pylist()):
            lines = Lines(slab, rolling)
            bits = row_bits[lines.row]
            key, line, tag, _ = variants(lines, rolling[0], np.arange(len(lines.size)))
            piece = ((tag + 1) * PIECES - 1) // lines.size[line]  # the k with k * n // PIECES <= tag < (k + 1) * n // PIECES
            wanted = bits[line] >> np.where(tag == WHOLE, PIECES, piece) & 1 > 0
            key, line, tag = key[wanted].view(np.int64), line[wanted], tag[wanted].astype(np.int32)
            none = np.zeros(len(key), dtype=np.int32)
            columns = [pa.array(x) for x in (key, lines.hashes[0].view(np.int64)[line], tag, none, none)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in KEY.split(", ")])


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, line and tag those whose key occurs in two lines, and all that are spread; each once."""
    none = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32)]
    held, shared_key = none, None  # rows of the last key while only one line has it; the key once two have it
    for batch in chain(batches, [None]):
        rows = none if batch is None else [batch[k].to_numpy() for k in range(5)]
        rows = [np.append(h, x) for h, x in zip(held, rows)]
        if not len(rows[0]):
            continue
        new = np.ones(len(rows[0]), dtype=bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in rows[:3]], axis=0)
        key, line, tag, spread, reach = rows = [x[new] for x in rows]
        begin = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
        end = np.append(begin[1:], len(key))
        shared = line[begin] != line[end - 1]
        shared[0] |= shared_key is not None and key[0] == shared_key
        going = np.repeat(shared, end - begin) | (spread > 0)
        upto = len(key) if batch is None or shared[-1] else begin[-1]
        held, shared_key = [x[upto:] for x in rows], key[-1] if shared[-1] else None
        columns = [pa.array(x[:upto][going[:upto]]) for x in (key, line, tag, reach)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "tag", "reach"])


def plain_lines(texts: pd.Series, wanted: pd.Series) -> pd.Series:
    """The words of each wanted line of a text."""
    out = []
    for text, lines_wanted in zip(texts, wanted):
        lines = text.encode("utf-8").split(b"\n")
        out.append([{**w, "line": b" ".join(lines[w["line_no"]].split()).decode("utf-8")} for w in lines_wanted])
    return pd.Series(out)


def words_apart(a: str, b: str, one_edit: bool = False) -> bool:
    """Word edit distance of at most one or a tenth of the words of the longer line, by furthest places on each diagonal."""
    x, y = a.split(" "), b.split(" ")
    bound = 1 if one_edit else max(1, max(len(x), len(y)) // 10)
    same, n = 0, min(len(x), len(y))
    while same < n and x[same] == y[same]:
        same += 1
    x, y = x[same:], y[same:]
    while x and y and x[-1] == y[-1]:
        x.pop()
        y.pop()
    n, m = len(x), len(y)
    if abs(n - m) > bound:
        return False
    had, has = Counter(x), Counter(y)
    if max((had - has).total(), (has - had).total()) > bound:
        return False  # an edit takes away or adds one word at most
    reached: dict[int, int] = {}  # diagonal (place in y less place in x) -> furthest place in x
    for edits in range(bound + 1):
        now = {}
        for d in range(-edits, edits + 1):
            at = 0 if not edits else max(reached.get(d, -2) + 1, reached.get(d + 1, -2) + 1, reached.get(d - 1, -2))
            at = min(at, n, m - d)
            if at < 0 or at + d < 0:
                continue
            while at < n and at + d < m and x[at] == y[at + d]:
                at += 1
            now[d] = at
        if now.get(m - n, -1) >= n:
            return True
        reached = now
    return False


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows as a struct ``d``, with document id and a hash of the text beside it under names of our own."""
    return docs.select(
        F.struct("*").alias("d"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body")
    )


def _position() -> Column:
    return F.struct(F.col("doc").isNull().alias("none"), "doc", "body", "line_no")


def _shared(keys: DataFrame) -> DataFrame:
    """The rows of the keys that two lines or more have."""
    rows = keys.repartition("key", "spread").sortWithinPartitions("key", "id", "tag")
    return rows.mapInArrow(shared_rows, "key long, id long, tag int, reach int")


def _held_keys(keyed: DataFrame, distinct: DataFrame) -> DataFrame:
    """The keys that two lines or more have, beside those lines (``at``: first occurrence)."""
    shared = _shared(keyed.select(F.col("d.text").alias("text")).mapInArrow(key_rows, KEY))
    lines = distinct.where(F.col("words") >= NEAR_WORDS).select(
        F.col("h1").alias("id"), "words", *SIGNATURE, F.col("first").alias("at")
    )
    return written(shared.join(lines, "id"), "line-keys")


def _short_pairs(held: DataFrame) -> DataFrame:
    """(id, e_id): lines with the earliest line that shares a variant with them, if it is before them."""
    own = F.struct("at", "id")
    shorter, whole = held.where(F.col("tag") > WHOLE), held.where(F.col("tag") == WHOLE)
    least = F.min(own).alias("least")
    found = [
        shorter.join(shorter.groupBy("key", "tag").agg(least), ["key", "tag"]),
        whole.join(shorter.groupBy("key").agg(least), "key"),
        shorter.join(whole.select("key", own.alias("least")), "key"),
    ]
    earlier = [x.where(F.col("least.at") < F.col("at")).select("id", "least") for x in found]
    pairs = earlier[0].union(earlier[1]).union(earlier[2])
    return pairs.groupBy("id").agg(F.min("least").alias("least")).select("id", F.col("least.id").alias("e_id"))


def _likely(rows: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """The rows (doc, body) that may stand in ``wanted`` (w_doc, w_body), or with ``left_anti`` the others: those of which
    a hash is marked in a few bits that go to every task, so that most of the others need not be shuffled."""
    spot = lambda doc, body: F.pmod(F.xxhash64(doc, body), F.lit(LIKELY_BLOCKS * LIKELY_BITS))
    bit = spot("w_doc", "w_body")
    marks = wanted.groupBy(F.floor(bit / LIKELY_BITS).alias("block")).agg(F.bitmap_construct_agg(bit % LIKELY_BITS).alias("marks"))
    bit = spot("doc", "body")
    byte = F.hex(F.substring("marks", F.floor(bit % LIKELY_BITS / 8).cast("int") + 1, F.lit(1)))
    marked = F.getbit(F.conv(byte, 16, 10).cast("long"), (bit % 8).cast("int")) == 1
    return rows.join(F.broadcast(marks), (F.floor(bit / LIKELY_BITS) == F.col("block")) & marked, how)


def _with_words(keyed: DataFrame, lines: DataFrame, label: str) -> DataFrame:
    """(h1, h2, bits, at, line) of the lines (h1, h2, bits, first): where a line first stands, and its words."""
    wanted = lines.groupBy(F.col("first.doc").alias("w_doc"), F.col("first.body").alias("w_body")).agg(
        F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "h1", "h2", "bits")).alias("wanted")
    )  # at most the lines of one document in a row; written, so that its size is known to the planner
    wanted = written(wanted, label + "-wanted")
    same = F.col("doc").eqNullSafe(F.col("w_doc")) & (F.col("body") == F.col("w_body"))
    plain = F.pandas_udf(plain_lines, "array<struct<h1: long, h2: long, bits: int, line_no: int, line: string>>")
    texts = _likely(keyed.select("doc", "body", F.col("d.text").alias("text")), wanted, "left_semi").join(wanted, same)
    texts = texts.select("doc", "body", F.inline(plain("text", "wanted")))
    texts = texts.select("h1", "h2", "bits", _position().alias("at"), "line").dropDuplicates(["h1", "h2"])
    return written(texts, label + "-texts")


def _later_of_near(pairs: DataFrame, texts: DataFrame, label: str, one_edit: bool = False) -> DataFrame:
    """(h1, h2) of the later line of each of the pairs (id, e_id) whose words, in ``texts``, are few edits apart."""
    one = texts.select(F.col("h1").alias("id"), F.struct("at", "h1", "h2").alias("one"), "line")
    other = texts.select(
        F.col("h1").alias("e_id"), F.struct("at", "h1", "h2").alias("other"), F.col("line").alias("other_line")
    )

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([words_apart(x, y, one_edit) for x, y in zip(a, b)], dtype=bool)

    near = pairs.join(one, "id").join(other, "e_id").where(verified("line", "other_line"))
    later = near.select(F.greatest("one", "other").alias("later")).select("later.h1", "later.h2")
    return written(later.distinct(), label + "-near")


def _verified(keyed: DataFrame, distinct: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    """``_later_of_near`` of the distinct pairs, their words fetched from the documents."""
    pairs = written(
        pairs.select(F.least("id", "e_id").alias("id"), F.greatest("id", "e_id").alias("e_id")).distinct(), label
    )
    ids = pairs.select("id").union(pairs.select("e_id")).distinct().withColumnRenamed("id", "h1")
    lines = distinct.join(ids, "h1", "left_semi").withColumn("bits", F.lit(0))
    return _later_of_near(pairs, _with_words(keyed, lines, label), label)


def _one_edit_lines(keyed: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2) of the lines with an earlier line one word apart."""
    shared = _shared(keyed.select(F.col("d.text").alias("text")).mapInArrow(piece_rows, KEY))
    bits = shared.groupBy(F.col("id").alias("h1")).agg(F.bit_or("tag").alias("bits"))
    texts = _with_words(keyed, distinct.join(bits, "h1"), "line-pieces")
    keys = _shared(texts.select("bits", "line").mapInArrow(word_rows, KEY))
    held = written(keys.join(texts.select(F.col("h1").alias("id"), "at"), "id"), "line-words")
    return _later_of_near(_short_pairs(held), texts, "line-one", one_edit=True)


def _near_lines(keyed: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2) of the lines with an earlier near line."""
    keys = _held_keys(keyed, distinct)
    low = GRAM_TAG - F.col("tag")
    order = F.coalesce("at.doc", F.lit(LAST_DOC)).alias("doc"), F.col("at.line_no").alias("line_no")
    places = low.alias("low"), (low + F.col("reach")).alias("high")
    held = keys.where((F.col("tag") <= GRAM_TAG) & F.col("key").isNotNull() & F.col("id").isNotNull())
    held = held.select("key", *order, "id", "words", *SIGNATURE, *places).repartition("key")  # one shuffle for both sides
    longer = F.greatest("words", "e_words")
    bound = F.floor(longer / 10)
    turned = sum((F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"e_b{k}"))) for k in range(2)), F.lit(0))
    byte = lambda c, k: F.shiftright(c, 8 * k).bitwiseAND(F.lit(255))
    counted = sum((F.abs(byte("counts", k) - byte("e_counts", k)) for k in range(BINS)), F.lit(0))
    added = F.abs(F.col("words") - F.col("e_words"))  # a word put in or left out turns one bit only, and one count
    meet = lambda low, e_low, high, e_high: F.greatest(low, e_low) - F.least(high, e_high) <= bound
    fits = (longer >= WIDE_WORDS) & (added <= bound) & meet("low", "e_low", "high", "e_high") & (turned <= 2 * bound - added)
    fits &= (F.col("e_id") != F.col("id")) & (counted <= 2 * bound - added)
    fields = [c for c in held.columns if c != "key"]
    least = held.groupBy("key").agg(F.min(F.struct(*fields)).alias("least"), (F.count("*") > 2).alias("more"))
    least = least.select("key", "more", *[F.col(f"least.{c}").alias(f"e_{c}") for c in fields if c not in ("doc", "line_no")])
    beside = held.join(least, "key").where((F.col("e_id") != F.col("id")) & (F.col("more") | fits))
    beside = written(beside.select(*held.columns, "more", F.when(fits, F.col("e_id")).alias("e_id")), "line-beside")
    first = beside.where(F.col("e_id").isNotNull()).select("id", "e_id")
    near = _verified(keyed, distinct, _short_pairs(keys).union(first), "line-least")
    held = beside.where("more").select(*held.columns)  # all pairs with the least line of a gram are settled
    # lengths are classed by powers of two; the lines a tenth apart stand in one class for most lines, in two for some
    size = lambda words: F.floor(F.log2(words)).cast("int")
    reached = [size(F.col("words") * ratio) for ratio in (0.899, 1 / 0.899)]
    near_size = F.explode(F.array_distinct(F.array(*reached))).alias("size")
    # the planner knows neither how many rows this explode makes nor how long the arrays ``before`` are: no broadcast
    sized = lambda rows: rows.select(*[F.col(c).alias(f"e_{c}") for c in rows.columns], size("words").alias("e_size")).hint("merge")
    same = (F.col("key") == F.col("e_key")) & (F.col("size") == F.col("e_size")) & fits
    spot, e_spot = F.struct("doc", "line_no"), F.struct("e_doc", "e_line_no")  # two texts of one id may share a spot
    later = F.col("open") & (e_spot <= spot)
    held = held.join(near.select(F.col("h1").alias("id"), F.lit(False).alias("open")), "id", "left")
    held = written(held.withColumn("open", F.coalesce("open", F.lit(True))), "line-more")
    with_other = held.select("*", near_size).join(sized(held), same & (later | (F.col("e_open") & (spot <= e_spot))), "left_semi")
    held = written(with_other.drop("size").repartition("id").distinct(), "line-open")
    back = Window.partitionBy("id").orderBy("low", "key").rowsBetween(-BEFORE, -1)
    held = held.withColumn("before", F.collect_list(F.struct("key", "low", "high")).over(back))
    met = F.exists(
        "before",
        lambda x: F.exists(
            "e_before", lambda y: (x["key"] == y["key"]) & meet(x["low"], y["low"], x["high"], y["high"])
        ),
    )
    pairs = held.select("*", near_size).join(sized(held), same & later & ~met).select("id", "e_id")
    return near.union(_verified(keyed, distinct, pairs, "line-rest")).distinct()


def _lines_to_drop(keyed: DataFrame, least_words: int, one_edit: bool) -> DataFrame:
    """(w_doc, w_body, gone, near): line numbers that go, and how many of them for a near line."""
    keyed = keyed.where(F.col("d.text").isNotNull())
    rows, schema = (bare_line_rows, BARE_LINE) if one_edit else (line_rows, LINE)
    lines = written(keyed.select("doc", "body", F.col("d.text").alias("text")).mapInArrow(rows, schema), "line-all")
    distinct = written(
        lines.groupBy("h1", "h2").agg(
            F.min(_position()).alias("first"),
            F.count("*").alias("times"),
            *[F.first(c).alias(c) for c in ("words", *SIGNATURE) if c in lines.columns],
        ),
        "line-distinct",
    )
    near = (_one_edit_lines if one_edit else _near_lines)(keyed, distinct).withColumn("near", F.lit(True))
    marks = (
        distinct.join(near, ["h1", "h2"], "left")
        .where((F.col("times") > 1) & (F.col("words") >= least_words) | F.col("near"))
        .select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    )
    gone = lines.select("doc", "body", "line_no", "h1", "h2").join(marks, ["h1", "h2"])
    gone = gone.where(F.col("near") | (_position() != F.col("first")))
    gone = gone.groupBy(F.col("doc").alias("w_doc"), F.col("body").alias("w_body")).agg(
        F.collect_set("line_no").alias("gone"), F.collect_set(F.when(F.col("near"), F.col("line_no"))).alias("near")
    )  # at most the lines of one document in a row; written, so that its size is known to the planner
    return written(gone, "line-gone")


def without_lines(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """The texts without the lines of the given numbers."""
    out = []
    for text, numbers in zip(texts, gone):
        if text is None or numbers is None or not len(numbers):
            out.append(text)
        else:
            drop = set(numbers)
            out.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop))
    return pd.Series(out, dtype=object)


def _with_drops(docs: DataFrame, least_words: int, one_edit: bool) -> DataFrame:
    keyed = _keyed(docs)
    gone = _lines_to_drop(keyed, least_words, one_edit)
    same = F.col("doc").eqNullSafe(F.col("w_doc")) & (F.col("body") == F.col("w_body"))
    cut = F.pandas_udf(without_lines, "string")
    shorter = _likely(keyed, gone, "left_semi").join(gone, same, "left")
    shorter = shorter.select("d", "gone", "near", cut("d.text", "gone").alias("rest"))
    none = [F.lit(None).cast(gone.schema[c].dataType).alias(c) for c in ("gone", "near")]
    return shorter.union(_likely(keyed, gone, "left_anti").select("d", *none, F.col("d.text").alias("rest")))


def dedup_lines(docs: DataFrame, least_words: int = MIN_WORDS, one_edit: bool = False) -> DataFrame:
    """The documents with ``text`` shortened, without those of which nothing is left; columns as before. Copies go of
    lines of ``least_words`` words and more; with ``one_edit`` near lines are one word apart at any length."""
    left = _with_drops(docs, least_words, one_edit).where(F.col("gone").isNull() | F.col("rest").rlike("[^\\x09-\\x0D\\x20]"))
    columns = [F.col("rest").alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]
    return left.select(*columns)


def line_report(docs: DataFrame, least_words: int = MIN_WORDS, one_edit: bool = False) -> DataFrame:
    """Per document: lines, how many go as copies and as near lines, and the digest of the text that is left; which
    lines go is set as for ``dedup_lines``."""
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    lines = F.coalesce(F.size(F.split("d.text", "\n", -1)), F.lit(0)).cast("long")
    return _with_drops(docs, least_words, one_edit).select(
        F.col("d.doc_id").alias("doc_id"),
        F.when(F.col("d.text").isNull(), F.lit(0)).otherwise(lines).alias("n_lines"),
        (F.when(F.col("gone").isNull(), F.lit(0)).otherwise(count("gone") - count("near"))).alias("n_copies"),
        (F.when(F.col("near").isNull(), F.lit(0)).otherwise(count("near"))).alias("n_near"),
        F.sha2("rest", 256).alias("rest_sha256"),
    )
