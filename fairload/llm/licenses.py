"""License scan by patience alignment.

A template and a stretch of text are aligned on the words that occur exactly once in both: of these anchors
the longest run that is in order on both sides is kept (longest increasing subsequence by patience sorting).
Equal words next to an anchor extend it, and the gaps between anchors are aligned in the same way. The
share of template words that are aligned is the coverage.

A text is cut into stretches of ``STRETCH`` template lengths that begin every half length, so that every
occurrence that is up to one and a half times as long as the template lies whole in one of them. A stretch
is aligned only if it holds enough of the template's words at all, counted with repeats: aligned words cannot
be more. Whole texts are scanned; the templates are a fixed, small query set.

Words are runs of letters, digits and inner dots in lower case; the numbers ``3`` and ``3.0`` are one word.

Words that tell licenses apart (numbers and ``TELLING``) must be aligned: a template is not found if one of its own is
nowhere aligned, or if the text has one of ``TELLING`` amid the aligned words that is not. Of stretches that overlap,
whichever their templates, the one with the most aligned words is reported.

Cases: a null text counts as empty and has no finding; a null doc_id is kept; repeated rows give repeated findings;
other columns are ignored; empty tables give an empty result. On ties of aligned
words the better covered stretch is reported, then the shorter, the first. A text that holds a license twice gives two findings.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
STRETCH = 2
WORD = re.compile(r"\w+(?:\.\w+)*")
WHOLE = re.compile(r"\d+\.0")
TELLING = frozenset(
    {"nc", "nd", "sa", "noncommercial", "noderivatives", "sharealike", "lesser", "affero", "apache", "gnu", "mit", "mozilla"}
)

# License notices as they are published.
NOTICES = {
    "MIT-short": "Released under the MIT License.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring "
        "rights to this work to the public domain worldwide."
    ),
}


def words_of(text: str) -> list[str]:
    return [w[:-2] if w[-2:] == ".0" and WHOLE.fullmatch(w) else w for w in WORD.findall(text.lower())]


def in_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first number, in which the second increases."""
    tops: list[int] = []  # last number of the best run of each length
    ends: list[int] = []  # index of that pair
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        before.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            ends.append(k)
        else:
            tops[pile], ends[pile] = b, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (text, template), in order on both sides."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(text[a:b]), Counter(template[c:d])
        at = {w: k for k, w in enumerate(template[c:d], c) if right[w] == 1 and left[w] == 1}
        anchors = in_order([(k, at[w]) for k, w in enumerate(text[a:b], a) if w in at])
        if not anchors:
            continue
        for k, ((x, y), (x2, y2)) in enumerate(zip(anchors, anchors[1:] + [(b, d)])):
            if k == 0:
                todo.append((a, x, c, y))
            todo.append((x, x2, y, y2))  # begins with the anchor itself, which the loop above takes
    return sorted(out)


class Found(NamedTuple):
    license: str
    coverage: float
    first_word: int
    last_word: int


class Templates:
    def __init__(self, notices: dict[str, str]) -> None:
        self.words = {name: words_of(text) for name, text in notices.items()}
        self.words = {name: words for name, words in self.words.items() if words}
        self.counts = {name: Counter(words) for name, words in self.words.items()}
        self.telling = {
            name: {w for w in words if w in TELLING or w[0].isdigit()} for name, words in self.words.items()
        }

    def scan(self, text: list[str], least: float) -> list[Found]:
        """Findings of all templates in a text, ordered by name and place."""
        found: list[tuple[int, Found]] = []  # with the number of aligned words
        present = set(text)
        for name, template in self.words.items():
            counts, need = self.counts[name], least * len(template)
            if sum(n for w, n in counts.items() if w in present) < need:
                continue
            size, step = STRETCH * len(template), max(1, len(template) // 2)
            places = [k for k, w in enumerate(text) if w in counts]
            seen = set()
            for place in places:
                # stretches that hold this word
                for start in range(max(0, (place - size) // step * step + step), place + 1, step):
                    if start in seen:
                        continue
                    seen.add(start)
                    part = text[start : start + size]
                    held = Counter(w for w in part if w in counts)
                    if sum(min(n, counts[w]) for w, n in held.items()) < need:
                        continue
                    pairs = align(part, template)
                    if len(pairs) >= need and self._told_apart(name, part, pairs):
                        cover = len(pairs) / len(template)
                        found.append((len(pairs), Found(name, cover, start + pairs[0][0], start + pairs[-1][0])))
        taken: list[Found] = []
        order = lambda x: (-x[0], -x[1].coverage, x[1].last_word - x[1].first_word, x[1].first_word)
        for _, f in sorted(found, key=order):
            if all(f.last_word < t.first_word or f.first_word > t.last_word for t in taken):
                taken.append(f)
        return sorted(taken, key=lambda f: (f.license, f.first_word))

    def _told_apart(self, name: str, part: list[str], pairs: list[tuple[int, int]]) -> bool:
        aligned = {a for a, _ in pairs}
        if not self.telling[name] <= {part[a] for a in aligned}:
            return False
        return not any(part[a] in TELLING and a not in aligned for a in range(pairs[0][0], pairs[-1][0]))


FOUND = "license: string, coverage: double, first_word: long, last_word: long"


def scan_licenses(docs: DataFrame, notices: dict[str, str] = NOTICES, least: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word) of every stretch that is at least ``least`` covered."""
    shared = docs.sparkSession.sparkContext.broadcast(notices)  # a fixed set of short texts

    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        templates = Templates(shared.value)
        for texts in parts:
            yield pd.Series([[f._asdict() for f in templates.scan(words_of(t), least)] for t in texts])

    scan_text = F.pandas_udf(scan, f"array<struct<{FOUND}>>")
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.select("doc_id", F.inline(scan_text("text")))
