"""License notices in whole texts, by patience alignment with templates.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. In a stretch of text a
template is aligned by patience: equal words at both ends are matched, words unique to both sides
are anchors, the longest increasing subsequence of them is kept, and the gaps between anchors are
aligned in the same way. The template's share of matched words is its coverage.

Stretches are found by an exact bound, not by a heuristic: matched words are words of the template,
so a stretch of SPREAD times the template's length with too few of these cannot reach COVERAGE.
All others are aligned, in overlapping windows, so that two copies in a row do not hide each
other's unique words. Of overlapping finds the one with the larger number of matched words stays.

Coverage is asked of both sides: of the words from the first match to the last, SPAN_SHARE have to be
matched. A find fails if one of the words between is a TELLING word that the template doesn't match
there, as it names another license (GNU Affero, NonCommercial), or if one of the NEGATING words stands
within two words before it. A find of a license that permits fails as well if its sentence goes on with a
restriction: one of SUFFIXES within two words (Creative Commons only), of RESTRICTING within BEHIND words, or there one of REFUSED
at most two words behind one of REFUSING.

Short templates have rules of their own. Up to NAMING words, what tells licenses apart (every word
that isn't in PLAIN) has to match; of longer ones, the number of a version. From TOLERANT words on, one plain word may differ even where
COVERAGE asks for all. Below TOLERANT words all have to match, and below TIGHT in one run.

Texts are scanned one by one in a single pass without a shuffle, so no key can be hot. Defined
results: a null or empty text has no finds; of equally good finds that overlap the shortest stays, then
that of the first template; a long text is scanned whole, by itself; rows that repeat a doc_id are rows of their own; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import wordhash
from .shared import table

#: The least share of a template that a find matches, and how much longer than the template it may be.
COVERAGE, SPREAD = 0.9, 1.5
#: The least share of the words of a find that are matched.
SPAN_SHARE = 0.75

#: Words of a template: below TIGHT it is matched as a run, from TOLERANT on one plain word may differ, up to NAMING no other may.
TIGHT, TOLERANT, NAMING = 5, 6, 16
#: Words by which no two licenses differ.
PLAIN = "a general gnu international is license licensed public the this under v version work"

#: Words that tell one license from another: between matched words they rule a find out.
TELLING = "affero lesser library agpl lgpl nc nd sa noncommercial noderivatives noderivs sharealike commercial derivatives alike limited proprietary no not non except"
NEGATING = "not never neither nor isn unlike without"
#: Words behind a find, in its sentence, by which it is a narrower license; RESERVED has nothing to narrow.
BEHIND, SUFFIXES, RESTRICTING = 6, "nc nd sa", "noncommercial noderivatives noderivs sharealike"
REFUSING, REFUSED, RESERVED = "no non not without", "commercial commercially derivatives derivative", "proprietary"

# Public notices, each with the identifier of its license. Results hold a template's number: new ones go last.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "All rights are reserved."),
    ("proprietary", "Alle Rechte vorbehalten."),
    ("proprietary", "Tous droits réservés."),
    ("proprietary", "Todos los derechos reservados."),
    ("BSD-3-Clause", "All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Distributed under the MIT License."),
    ("Apache-2.0", "Licensed under Apache 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0."),
    *((f"GPL-{v}.0", f"Licensed under the {name}.") for v in (3, 2) for name in (f"GNU General Public License, version {v}", f"GNU General Public License v{v}.0", f"GPL-{v}.0", f"GPLv{v}")),
    ("GPL-3.0", "Licensed under GPLv3."),
    ("GPL-2.0", "Licensed under GPLv2."),
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in ("BY-ND", "BY-NC-SA", "BY-NC-ND")),
    *((f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.") for k, name in (("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))),
    *((k, f"SPDX-License-Identifier: {k}") for k in ("MIT", "Apache-2.0", "GPL-3.0", "GPL-3.0-or-later", "GPL-2.0", "GPL-2.0-or-later", "BSD-3-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0")),
    *((f"AGPL-{v}.0", f"{start} under the {name}.") for v in (3,) for start in ("Licensed", "This work is licensed") for name in (f"GNU Affero General Public License, version {v}", f"GNU Affero General Public License v{v}.0", f"AGPL-{v}.0", f"AGPLv{v}")),
    *((f"LGPL-{v}", f"{start} under the {name}.") for v in ("2.0", "2.1", "3.0") for start in ("Licensed", "This work is licensed") for name in (f"GNU Lesser General Public License, version {v.removesuffix('.0')}", f"GNU Lesser General Public License v{v}", f"GNU Library General Public License, version {v.removesuffix('.0')}", f"LGPL-{v}", f"LGPLv{v.removesuffix('.0')}")),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    *((f"LGPL-{v}-or-later", f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {v.removesuffix('.0')} of the License, or (at your option) any later version.") for v in ("2.1", "3.0")),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    *((k, f"SPDX-License-Identifier: {k}") for k in ("AGPL-3.0", "AGPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-or-later", "BSD-2-Clause", "ISC", "CC0-1.0", "Unlicense")),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((k, f"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {first} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {second} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {third}") for k, first, second, third in (
        ("BSD-2-Clause", "1.", "2.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
        ("BSD-3-Clause", "1.", "2.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    )),
]

_STOPS = frozenset(b".!?")
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Places in a and b that patience alignment matches, ascending."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, k, j, m = gaps.pop()
        while i < k and j < m and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            found.append((k, m))
        if i == k or j == m:
            continue
        in_a, in_b = Counter(a[i:k]), Counter(b[j:m])
        place = {w: y for y, w in enumerate(b[j:m], j) if in_b[w] == 1}
        unique = [(x, place[w]) for x, w in enumerate(a[i:k], i) if in_a[w] == 1 and w in place]
        anchors = [unique[n] for n in increasing([y for _, y in unique])]
        if anchors:
            found += anchors
            ends = [(i - 1, j - 1), *anchors, (k, m)]
            gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:])]
    return sorted(found)


def _words(column: pa.Array):
    """Bytes, starts, ends and hashes of words, number of each text's first word."""
    data, offs = wordhash.text_bytes(column)
    data = wordhash.LOWER[data]
    starts, ends, first = wordhash.word_spans(np.where(_INSIDE[data], data, np.uint8(32)), offs)
    return data, offs, starts, ends, wordhash.hash_spans(data, starts, ends), first


class Scanner:
    def __init__(self, templates=TEMPLATES, coverage: float = COVERAGE, spread: float = SPREAD):
        hashes = [_words(pa.array([text]))[4] for _, text in templates]
        self.licenses = [name for name, _ in templates]
        self.words = [h.tolist() for h in hashes]
        self.sorted = [np.unique(h) for h in hashes]
        self.all = np.unique(np.concatenate(hashes))
        self.need = [math.ceil(coverage * len(h)) for h in hashes]
        self.width = [math.ceil(spread * len(h)) if len(h) >= TIGHT else len(h) for h in hashes]
        plain, self.telling, self.negating, self.suffixes, self.restricting, self.refusing, self.refused = (
            set(_words(pa.array([w]))[4].tolist()) for w in (PLAIN, TELLING, NEGATING, SUFFIXES, RESTRICTING, REFUSING, REFUSED)
        )
        version = _words(pa.array(["version"]))[4][0]
        self.naming = [{i for i, w in enumerate(words) if (w not in plain if len(words) <= NAMING else i and words[i - 1] == version)} for words in self.words]
        if coverage < 1:
            self.need = [n - 1 if TOLERANT <= n == len(words) else n for n, words in zip(self.need, self.words)]

    def scan(self, column: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """Finds: text, template, start, end (code points), coverage."""
        data, offs, starts, ends, hashes, first = _words(column)
        if not len(hashes):
            return []
        at = np.flatnonzero(np.isin(hashes, self.all))
        own, text = hashes[at], np.searchsorted(first, at, side="right") - 1
        finds = []
        for t, words in enumerate(self.words):
            place = at[np.isin(own, self.sorted[t])]
            if len(place) < self.need[t]:
                continue
            of = np.searchsorted(first, place, side="right") - 1
            within = np.searchsorted(place, np.minimum(place + self.width[t], first[of + 1]))
            good = np.flatnonzero(within - np.arange(len(place)) >= self.need[t])
            for a, b in self._runs(place[good], self.width[t], first):
                finds += self._aligned(t, a, b, hashes, first, lambda at: self._behind(at, data, starts, ends, hashes, first))
        finds = _best(finds)
        point = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with a byte
        out = []
        for n, t, a, b in finds:
            text_at = int(np.searchsorted(first, a, side="right") - 1)
            before = int(point[offs[text_at] - 1]) if offs[text_at] else 0
            out.append((text_at, t, int(point[starts[a]]) - 1 - before, int(point[ends[b] - 1]) - before, n / len(self.words[t])))
        return out

    @staticmethod
    def _runs(places: np.ndarray, width: int, first: np.ndarray):
        """Stretches (first start, last start) of possible starts in one text, less than a width apart."""
        if not len(places):
            return
        of = np.searchsorted(first, places, side="right")
        cut = np.flatnonzero((np.diff(places) > width) | (np.diff(of) > 0))
        yield from zip(places[np.r_[0, cut + 1]].tolist(), places[np.r_[cut, len(places) - 1]].tolist())

    def _aligned(self, t: int, a: int, b: int, hashes: np.ndarray, first: np.ndarray, behind):
        words, width, need = self.words[t], self.width[t], self.need[t]
        end = int(first[np.searchsorted(first, a, side="right")])
        step = max(1, len(words) // 4)
        bag = Counter(words)
        while a <= b:
            window = hashes[a : min(a + width + step, end)].tolist()
            if len(words) < TIGHT:
                window = window[:width]
            if (Counter(window) & bag).total() >= need:
                found = self._found(t, window)
                if found and (self._denied(a + found[0][0], hashes, first) or self.licenses[t] != RESERVED and self._narrowed(t, behind(a + found[-1][0]))):
                    a += found[0][0] + 1
                    continue
                if found:
                    yield len(found), t, a + found[0][0], a + found[-1][0]
                    a += found[-1][0] + 1
                    continue
            a += step

    @staticmethod
    def _behind(at: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> list:
        """Up to BEHIND words that follow a word in its sentence."""
        last = int(first[np.searchsorted(first, at, side="right")])
        out: list = []
        for i in range(at + 1, min(at + 1 + BEHIND, last)):
            between = data[ends[i - 1] : starts[i]].tobytes()
            if not _STOPS.isdisjoint(between) or b"\n\n" in between:
                break
            out.append(int(hashes[i]))
        return out

    def _narrowed(self, t: int, behind: list) -> bool:
        """Whether words behind a find restrict what it permits."""
        if self.licenses[t].startswith("CC") and not self.suffixes.isdisjoint(behind[:2]) or not self.restricting.isdisjoint(behind):
            return True
        return any(w in self.refusing and not self.refused.isdisjoint(behind[i + 1 : i + 3]) for i, w in enumerate(behind))

    def _denied(self, at: int, hashes: np.ndarray, first: np.ndarray) -> bool:
        """Whether one of the two words before a place denies what follows."""
        begin = int(first[np.searchsorted(first, at, side="right") - 1])
        return not self.negating.isdisjoint(hashes[max(begin, at - 2) : at].tolist())

    def _found(self, t: int, window: list) -> list[tuple[int, int]]:
        """The matched places of a window, none if they are too few.

        Words that follow may hide the unique ones, so the window grows: word by word for a short
        template, by quarters of a long one.
        """
        words, need = self.words[t], self.need[t]
        step = 1 if len(words) <= NAMING else max(1, len(words) // 4)
        best: list[tuple[int, int]] = []
        for size in [*range(need, len(window), step), len(window)]:
            found = align(window[:size], words)
            if len(found) > len(best) and self._holds(t, found, window):
                best = found
            if len(best) == len(words):
                break
        return best if len(best) >= need else []

    def _holds(self, t: int, found: list[tuple[int, int]], window: list) -> bool:
        """Whether matches name this license and no other, and are dense enough."""
        if len(found) < self.need[t] or not self.naming[t] <= {j for _, j in found}:
            return False
        a, b = found[0][0], found[-1][0] + 1
        matched = {i for i, _ in found}
        return len(found) >= SPAN_SHARE * (b - a) and self.telling.isdisjoint(w for i, w in enumerate(window[a:b], a) if i not in matched)


def _best(finds: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of finds that overlap, the one with the most matched words; then the shortest, the first template."""
    taken: list[tuple[int, int]] = []
    out = []
    for n, t, a, b in sorted(finds, key=lambda f: (-f[0], f[3] - f[2], f[1], f[2])):
        k = bisect.bisect_left(taken, (a, a))
        if (k == len(taken) or taken[k][0] > b) and (k == 0 or taken[k - 1][1] < a):
            taken.insert(k, (a, b))
            out.append((n, t, a, b))
    return sorted(out, key=lambda f: f[2])


_scanners: dict = {}


def _scan(templates: tuple, coverage: float, spread: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = templates, coverage, spread
        scanner = _scanners.get(key) or _scanners.setdefault(key, Scanner(*key))
        for whole in batches:
            for batch in wordhash.slices(whole, "text"):
                found = scanner.scan(batch.column("text"))
                row, t, start, end, share = map(list, zip(*found)) if found else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array([scanner.licenses[k] for k in t], pa.string()), pa.array(t, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(share, pa.float64())],
                    names=["doc_id", "license", "template", "start", "end", "coverage"],
                )

    return run


def find(docs: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE, spread: float = SPREAD) -> DataFrame:
    """A row for each notice: doc_id, license, number of the template, start and end in code points, coverage."""
    return docs.select("doc_id", "text").mapInArrow(_scan(tuple(templates), coverage, spread), "doc_id long, license string, template int, start long, end long, coverage double")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


#: Alignment is beyond SQL; tests check planted notices, and the subsequences against all subsets.
SQL: dict = {}
