"""Licence scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Texts and templates are lower-cased words, cut into shingles of five words (a template of fewer words
is one shingle of its own length). Overlapping windows of four shingles, begun at every second one,
run over the whole text; each has `bands` MinHash values, one row to a band. A template owns the
values of all its windows, so wherever an occurrence lies, some window of the text shares at least
one shingle in four with one of the template's: the chance that all bands miss is (3/4) ** bands,
at most MISS. A window whose band value a template owns is a candidate; then the shingles of the
template that the text has around it are counted exactly, and SIMILARITY of them or more make a match.

Documents stream past the templates, which are a fixed list, and are never shuffled.

Defined results: a null or empty text has no match; matches of one licence that overlap are one;
templates without words match nothing; templates of over MOST_WORDS words together are an error; rows with a null or repeated id return as often as they come;
an empty table gives an empty result; columns of other names pass through unread.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import spread, table
from lexmill.llm.decontaminate import words_of
from lexmill.session import ship

SHINGLE, SIMILARITY, WINDOW, STEP = 5, 0.8, 4, 2
MISS, SEED = 1e-4, 11
#: Words that all templates may have together, since they are broadcast; some 400 MB in a worker.
MOST_WORDS = 1_000_000
#: Words that are hashed at once.
CHUNK = 400_000

# Notices by which licences are known.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "GPL-3.0": [
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "GPL-2.0": ["it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "LGPL": ["it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-SA-4.0": ["licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "all-rights-reserved": ["All rights reserved"],
}

# Core phrases of short notices. Up to eight words have to be there all, so they tell versions apart.
_PHRASES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0 licensed", "Apache-2.0 licensed"],
    "MIT": ["under the terms of the MIT License", "under an MIT License", "under the MIT Licence", "The MIT License (MIT)", "MIT License Copyright (c)", "is MIT licensed", "is licensed under MIT", "licensed under MIT license"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "version 3 of the GNU Affero General Public License", "under the GNU AGPLv3", "under the AGPL v3", "under the AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "LGPL": ["GNU Lesser General Public License", "GNU Library General Public License", "under the LGPL v3", "under the LGPL v2.1"],
    "BSD": ["under the BSD License", "under a BSD License", "BSD-style license", "BSD 2-Clause License", "BSD 3-Clause License", "2-clause BSD license", "3-clause BSD license", "Simplified BSD License", "New BSD License", "Modified BSD License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "under the MPL 2.0"],
    "ISC": ["under the ISC License", "ISC License Copyright (c)", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0 Public Domain Dedication", "Creative Commons Zero v1.0", "Creative Commons CC0 license", "under the CC0 license", "has waived all copyright and related or neighboring rights"],
    "Unlicense": ["under the Unlicense License", "This is free and unencumbered software released into the public domain", "refer to unlicense.org"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v 2.0", "Eclipse Public License v2.0"],
    "EPL-1.0": ["Eclipse Public License, version 1.0", "Eclipse Public License 1.0", "Eclipse Public License v 1.0", "Eclipse Public License v1.0"],
    "BSL-1.0": ["Boost Software License, version 1.0", "Boost Software License 1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"],
    "Zlib": ["under the zlib License", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "WTFPL": ["Do What The Fuck You Want To Public License"],
    "Artistic-2.0": ["under the Artistic License 2.0", "The Artistic License 2.0"],
}
# Whole texts of the licences that are short; their parts are above.
_TEXTS = {
    "MIT": TEMPLATES["MIT"][1] + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Unlicense": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
}


def _short_forms() -> dict[str, list[str]]:
    """Notices that are made alike for many licences: GNU and Creative Commons ones by version, and SPDX tags."""
    out: dict[str, list[str]] = defaultdict(list)
    for v in "23":
        name = f"GPL-{v}.0"
        out[name] += [f"GNU General Public License{x}" for x in (f", version {v}", f" v{v}", f" v{v}.0", f" {v}.0", f" as published by the Free Software Foundation, version {v}", f" Version {v} or later")]
        out[name] += [f"version {v} of the GNU General Public License", f"under the GNU GPL v{v}", f"under the GNU GPLv{v}", f"under the terms of the GPLv{v}", f"under the GPL v{v}", f"under the GPL version {v}", f"licensed under the GPLv{v}", f"licensed under GPL-{v}.0"]
    words = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for v, where in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
            said = "-".join(words[w] for w in kind.split("-"))
            apart = {said, said.replace("NonCommercial", "Non-Commercial"), said.replace("ShareAlike", "Share Alike"), said.replace("NoDerivatives", "NoDerivs"), said.replace("NoDerivatives", "No Derivatives")}
            out[f"CC-{kind}-{v}"] += [f"CC {kind} {v}", f"creativecommons.org/licenses/{kind}/{v}", *(f"Creative Commons {x} {v} {tail}" for x in sorted(apart) for tail in (where, "License", "licence"))]
    for name in [*TEMPLATES, *_PHRASES, *out]:
        if name not in ("BSD", "LGPL", "all-rights-reserved"):
            out[name].append(f"SPDX-License-Identifier: {name}")
    out["BSD"] += ["SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause"]
    out["LGPL"] += [f"SPDX-License-Identifier: LGPL-{v}" for v in ("2.0", "2.1", "3.0")]
    return out


for _more in (_PHRASES, {k: [t] for k, t in _TEXTS.items()}, _short_forms()):
    for _name, _texts in _more.items():
        _own = TEMPLATES.setdefault(_name, [])
        _own += [t for t in dict.fromkeys(_texts) if t not in _own]


def shingle_set(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


class Words(dict):
    """64-bit hashes of words, filled on demand and emptied when full."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word, SEED)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return out ^ (out >> np.uint64(29))


def window_minima(values: np.ndarray, size: int, step: int) -> np.ndarray:
    """The least value of each window of `size`, begun at every `step`-th value; size is a multiple of step."""
    whole = np.concatenate([values, np.full(-len(values) % step, np.uint64(2**64 - 1))]).reshape(-1, step).min(axis=1)
    out = whole
    for k in range(1, size // step):
        out = np.minimum(out[: max(1, len(whole) - k)], whole[k:]) if len(whole) > k else out
    return out


class Finder:
    """The templates of one shingle width, by the values of their windows."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], width: int, bands: int, seen: Words):
        self.templates, self.width, self.bands = templates, width, bands
        self.shingles = [shingle_set(w, width) for _, w in templates]
        rng = np.random.default_rng(SEED + width)
        self.factors = rng.integers(0, 2**63, bands, np.uint64) * np.uint64(2) + np.uint64(1)
        self.single: dict[int, set[int]] = defaultdict(set)
        for t, (_, words) in enumerate(templates):
            if width < SHINGLE:
                self.single[int(shingle_hashes(seen.of(words), width)[0])].add(t)
        self.single, self.held = dict(self.single), np.zeros(1 << 16, bool)
        self.held[[v >> 48 for v in self.single]] = True
        self.owners: list[dict[int, set[int]]] = [defaultdict(set) for _ in range(bands)]
        for t, (_, words) in enumerate(templates):
            hashes = shingle_hashes(seen.of(words), width)
            for b, factor in enumerate(self.factors):
                values = hashes * factor
                for a in range(max(1, len(values) - WINDOW + 1)):
                    self.owners[b][int(values[a : a + WINDOW].min())].add(t)
        self.owners = [dict(o) for o in self.owners]
        self.maybe = np.zeros((bands, 1 << 16), bool)
        for b, owner in enumerate(self.owners):
            self.maybe[b, [v >> 48 for v in owner]] = True

    def candidates(self, hashes: np.ndarray) -> dict[int, set[int]]:
        """Templates by the places of the windows that retrieve them."""
        found: dict[int, set[int]] = defaultdict(set)
        if self.width < SHINGLE:  # all templates are one shingle, so it is looked up itself
            for at in np.flatnonzero(self.held[hashes >> np.uint64(48)]).tolist():
                for t in self.single.get(int(hashes[at]), ()):
                    found[t].add(at)
        elif len(hashes):
            for b in range(self.bands):
                minima = window_minima(hashes * self.factors[b], WINDOW, STEP)
                for at in np.flatnonzero(self.maybe[b][minima >> np.uint64(48)]).tolist():
                    for t in self.owners[b].get(int(minima[at]), ()):
                        found[t].add(at * STEP)
        return found

    def matches(self, t: int, places: list[int], words: list[bytes], start: int, end: int) -> list[tuple[str, float, int, int]]:
        """Verified matches of a template in words[start:end], whose windows at the sorted `places` retrieved it.

        From the left, the first stretch of the template's length that has enough of its shingles, moved on to the
        best one that begins within it. What surrounds several places is read once.
        """
        n, w, out, a = len(self.templates[t][1]), self.width, [], start
        k = 0
        while k < len(places):
            a, z = max(a, places[k] - n), 0
            while k < len(places) and places[k] - n <= max(z, a):
                z = min(end, places[k] + w + WINDOW + 2 * n)
                k += 1
            out += self.verified(t, [(i, s) for i in range(a, z - w + 1) if (s := tuple(words[i : i + w])) in self.shingles[t]], start)
            a = z
        return out

    def verified(self, t: int, held: list[tuple[int, tuple]], start: int) -> list[tuple[str, float, int, int]]:
        """Matches among the shingles (place, shingle) of a stretch; each is counted in and out of a moving window once."""
        n, size = len(self.templates[t][1]), len(self.shingles[t])
        counts: Counter = Counter()
        distinct, last, r = [], [], 0
        for i, s in held:
            while r < len(held) and held[r][0] - i < n:
                counts[held[r][1]] += 1
                r += 1
            distinct.append(len(counts))
            last.append(r - 1)
            counts[s] -= 1
            if not counts[s]:
                del counts[s]
        out, k = [], 0
        while k < len(held):
            if distinct[k] < SIMILARITY * size:
                k += 1
                continue
            best = max(range(k, last[k] + 1), key=lambda j: (distinct[j], -j))
            first, done = held[best][0], held[last[best]][0] + self.width
            out.append((self.templates[t][0], distinct[best] / size, first - start, done - start))
            k = bisect_left(held, (done,), best)
        return out


def finders(templates: dict[str, list[str]], miss: float = MISS) -> list[Finder]:
    """A finder for each shingle width that the templates need."""
    by_width: dict[int, list] = defaultdict(list)
    for name, texts in templates.items():
        for words in map(words_of, texts):
            if words:
                by_width[min(SHINGLE, len(words))].append((name, words))
    if (n := sum(len(words) for group in by_width.values() for _, words in group)) > MOST_WORDS:
        raise ValueError(f"templates of {n} words are too many for a broadcast; scan with parts of at most {MOST_WORDS} words")
    bands = math.ceil(math.log(miss) / math.log(1 - 1 / WINDOW))
    seen = Words()
    return [Finder(group, width, bands, seen) for width, group in sorted(by_width.items())]


def scan_texts(texts: list[str | None], found_by: list[Finder], seen: Words) -> list[list[tuple[str, float, int, int]]]:
    """The matches (licence, containment, first word, word after the last) of each text."""
    out: list[list] = [[] for _ in texts]
    k = 0
    while k < len(texts):
        flat: list[bytes] = []
        bounds: list[tuple[int, int, int]] = []
        while k < len(texts) and (not flat or len(flat) < CHUNK):
            words = words_of(texts[k])
            bounds.append((k, len(flat), len(flat) + len(words)))
            flat += words
            flat += [b""] * (SHINGLE + WINDOW)  # no window with words of two texts can look like one of a template's
            k += 1
        hashes, ends = seen.of(flat), [e for _, _, e in bounds]
        for finder in found_by:
            for t, places in finder.candidates(shingle_hashes(hashes, finder.width)).items():
                by_doc: dict[int, list[int]] = defaultdict(list)
                for p in sorted(places):
                    by_doc[min(int(np.searchsorted(ends, p, "right")), len(ends) - 1)].append(p)
                for d, at in by_doc.items():
                    doc, start, end = bounds[d]
                    out[doc] += finder.matches(t, at, flat, start, end)
    return [merged(m) for m in out]


def merged(matches: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
    """Matches in order, those of one licence that overlap being one, with the most that a template of it has."""
    out: dict[str, list] = defaultdict(list)
    for name, share, first, end in sorted(matches, key=lambda x: (x[2], x[3])):
        own = out[name]
        if own and first < own[-1][3]:
            own[-1] = (name, max(share, own[-1][1]), own[-1][2], max(end, own[-1][3]))
        else:
            own.append((name, share, first, end))
    return sorted((m for own in out.values() for m in own), key=lambda x: (x[2], x[0], x[3]))


MATCHES = T.ArrayType(T.StructType([T.StructField("licence", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())]))
_seen = Words()


def scan_licences(docs: DataFrame, text_col: str = "text", templates: dict[str, list[str]] | None = None, column: str = "licences") -> DataFrame:
    """docs with a column of matches (licence, containment, first_word, end_word)."""
    spark = docs.sparkSession
    ship(spark)
    held, at = spark.sparkContext.broadcast(finders(templates or TEMPLATES)), docs.columns.index(text_col)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields] + [T.StructField(column, MATCHES)])

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("licence", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
        for batch in batches:
            found = scan_texts(batch.column(at).to_pylist(), held.value, _seen)
            rows = [[{"licence": a, "containment": b, "first_word": c, "end_word": d} for a, b, c, d in m] for m in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan_licences(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    names = F.array_join(F.sort_array(F.array_distinct(F.transform("licences", lambda m: m["licence"]))), ",")
    least = F.array_min(F.transform("licences", lambda m: m["containment"]))
    return docs.select("doc_id", F.size("licences").cast("long").alias("n_matches"), names.alias("licences"), least.alias("least_containment"))
