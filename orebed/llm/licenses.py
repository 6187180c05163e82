"""License scans: winnowed fingerprints of templates pick candidates, banded alignment of words reports coverage and spans.

Each template's word n-grams are winnowed (the least hash of every window is kept; Schleimer, Wilkerson and Aiken, 2003), so that
a text that shares a run of GRAM + WINDOW - 1 words with a template has one of its fingerprints. An inverted index of the few
templates goes to every task, and a text is asked for all its n-grams. Where fingerprints of a template lie close together, the
template's words are aligned with the text's along the fingerprints' diagonal, within a band. Fingerprints that this leaves are
chained in text order across longer insertions and omissions, and aligned within a band that holds the chain.

Templates of fewer than GRAM words are refused.

Rows: a null or empty text has no match. Equal rows each give their matches. Matches of one template don't overlap; a match
within a larger match of another template is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect, insort
from collections import defaultdict
from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame

from orebed.llm.frames import map_columns, pick

# Notices of public licenses.
TEMPLATES = {
    "All-Rights-Reserved": "All rights reserved.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-short": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
GRAM, WINDOW = 3, 2
TOKEN = re.compile(r"[A-Za-z0-9]+")
TOKEN_BYTES = re.compile(rb"[a-z0-9]+")
#: The index goes to every task: so many words of templates at most.
MAX_TEMPLATE_WORDS = 1_000_000


@dataclass(frozen=True)
class Scan:
    """band: how far an alignment may leave its diagonal. min_coverage: share of a template's words that a match must have."""

    band: int = 6
    min_coverage: float = 0.8


def tokens(text: str) -> list[bytes]:
    return TOKEN_BYTES.findall(text.encode().lower())


def winnow(words: list[bytes]) -> list[int]:
    """Places of the kept n-grams: in each window the least hash, of equal ones the last."""
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + GRAM])) for i in range(max(1, len(words) - GRAM + 1))]
    kept = {min(range(i, min(i + WINDOW, len(hashes))), key=lambda j: (hashes[j], -j)) for i in range(max(1, len(hashes) - WINDOW + 1))}
    return sorted(kept)


class Index:
    """Templates' words, and which of them have an n-gram where."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {name: tokens(text) for name, text in templates.items()}
        if sum(map(len, self.words.values())) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
        if short := [name for name, words in self.words.items() if len(words) < GRAM]:
            raise ValueError(f"templates of fewer than {GRAM} words: {', '.join(short)}")
        self.grams: dict[tuple[bytes, ...], list[tuple[str, int]]] = defaultdict(list)
        for name, words in self.words.items():
            for i in winnow(words):
                self.grams[tuple(words[i : i + GRAM])].append((name, i))
        self.keys = frozenset(self.grams)

    def hits(self, words: list[bytes]) -> dict[str, list[tuple[int, int]]]:
        """For each template the places (in the text, in the template) of the fingerprints that they share."""
        out = defaultdict(list)
        grams = list(zip(*(words[i:] for i in range(GRAM))))
        if self.keys.isdisjoint(grams):
            return out
        for i, gram in enumerate(grams):
            if gram in self.keys:
                for name, at in self.grams[gram]:
                    out[name].append((i, at))
        return out


def align(template: list[bytes], text: list[bytes], offset: int, band: int) -> tuple[int, int, int]:
    """(equal words, first word, end) of the longest common subsequence with text places within band of offset + template place.

    The first and the end are places in the text of the first and past the last equal word; of equal lengths the shortest span.
    """
    width = 2 * band + 2
    none = (0, 0, 0)  # equal words, minus the first place, minus the end: larger is better
    row = [none] * (width + 1)
    for i, word in enumerate(template):
        new = [none] * (width + 1)
        for k in range(1, width):
            j = offset + i + k - 1 - band
            best = max(new[k - 1], row[k + 1])
            if 0 <= j < len(text) and text[j] == word:
                n, first, _ = row[k]
                best = max(best, (n + 1, first if n else j, -(j + 1)), key=lambda x: (x[0], x[1], x[2]))
            new[k] = best
        row = new
    n, first, end = max(row)
    return n, first, -end


def _groups(hits: list[tuple[int, int]], reach: int, band: int) -> list[list[int]]:
    """The diagonals of hits that lie close together."""
    groups: list[list[int]] = []
    first = (0, 0)
    for at, place in sorted((i - j, i) for i, j in hits):
        if not groups or at - first[0] > band or place - first[1] > reach:
            groups.append([])
            first = (at, place)
        groups[-1].append(at)
    return groups


def _chains(hits: list[tuple[int, int]], reach: int) -> list[list[int]]:
    """The diagonals of hits that follow each other in the text and in the template, gaps of up to reach; longest first."""
    hits = sorted(hits)
    best: list[tuple[int, int]] = []  # length of the longest chain that ends here, and the hit before
    low = 0
    for k, (i, j) in enumerate(hits):
        while i - hits[low][0] > reach:
            low += 1
        n, m = max(((best[m][0], m) for m in range(low, k) if hits[m][0] < i and hits[m][1] < j), default=(0, -1))
        best.append((n + 1, m))
    out, used = [], set()
    for k in sorted(range(len(hits)), key=lambda k: -best[k][0]):
        chain = []
        while k >= 0 and k not in used:
            used.add(k)
            chain.append(hits[k][0] - hits[k][1])
            k = best[k][1]
        if len(chain) > 1:
            out.append(chain)
    return out


def _occurrences(template: list[bytes], words: list[bytes], hits: list[tuple[int, int]], scan: Scan) -> list[tuple[int, int, int]]:
    """(first word, end, words matched) of matches that don't overlap.

    What groups by diagonal leave is searched again, without the words that are taken, until they give no more; then hits are
    chained across longer insertions and omissions.
    """
    reach, least = len(template) + 2 * scan.band, scan.min_coverage * len(template)
    kept: list[tuple[int, int, int]] = []
    places: list[tuple[int, int]] = []  # of those kept, sorted: they don't overlap, so the neighbours tell whether another one would
    words = list(words)
    chained = False
    while hits:
        own = set()
        for offsets in _chains(hits, reach) if chained else _groups(hits, reach, scan.band):
            low, high = min(offsets), max(offsets)
            if chained and high - low <= scan.band:
                continue
            offset, band = ((low + high) // 2, (high - low + 1) // 2 + scan.band) if chained else (offsets[len(offsets) // 2], scan.band)
            n, first, end = align(template, words, offset, band)
            if n >= least:
                own.add((first, end, n))
        known = len(kept)
        for first, end, n in sorted(own, key=lambda x: (-x[2], x[1] - x[0], x[0])):
            after = bisect(places, (first, first))
            if (after == 0 or places[after - 1][1] <= first) and (after == len(places) or end <= places[after][0]):
                kept.append((first, end, n))
                insort(places, (first, end))
        if len(kept) == known:
            if chained:
                break
            chained = True
            continue
        for first, end, _ in kept[known:]:
            words[first:end] = [b""] * (end - first)
        hits = [(i, j) for i, j in hits if all(words[i : i + GRAM])]
    return kept


def matches(text: str, index: Index, scan: Scan) -> list[tuple[str, int, int, int, int]]:
    """(template, start, end in code points, words matched, words of the template), by start."""
    words = tokens(text)
    found = []
    for name, hits in index.hits(words).items():
        template = index.words[name]
        found += [(name, first, end, n, len(template)) for first, end, n in _occurrences(template, words, hits, scan)]
    if not found:
        return []
    spans = [m.span() for m in TOKEN.finditer(text)]
    found.sort(key=lambda x: (x[1], -x[3], x[0]))
    out, reach = [], []
    for name, first, end, n, size in found:
        reach = [x for x in reach if x[1] > first]
        if not any(a <= first and end <= b and n < m for a, b, m in reach):
            out.append((name, spans[first][0], spans[end - 1][1], n, size))
            reach.append((first, end, n))
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, scan: Scan = Scan()) -> DataFrame:
    """doc_id, license, span_start, span_end (code points, end exclusive), matched_words, template_words, coverage: a row for each match."""
    index = Index(templates)

    def run(ids: list, texts: list) -> tuple[list, ...]:
        rows = [(i, *m, m[3] / m[4]) for i, t in zip(ids, texts) if t for m in matches(t, index, scan)]
        return tuple(map(list, zip(*rows))) if rows else ([],) * 7

    return map_columns(pick(docs, "doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, license string, span_start long, span_end long, matched_words long, template_words long, coverage double")
