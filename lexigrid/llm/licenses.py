"""License scans: winnowed fingerprints of templates, then banded alignment of the candidates.

Words are runs of ASCII letters and digits, lower-cased. Each template's word `GRAM`-grams are winnowed
(of every `WINDOW` neighbours the least hash is kept) into an inverted index gram -> (template, place).
All grams of a document are looked up there, so any shared run of GRAM + WINDOW - 1 words is found.
Hits of a template that go on near one diagonal make a candidate, which a banded alignment of the words,
outward from a hit, settles: matched words, coverage of the template, and the span in the text (code points,
end exclusive). A match covers at least `COVERAGE` of its template, holds the words that tell it from its
kin and none that tell its kin from it (`RULES`: version numbers, lesser, noncommercial ...). Of matches that
overlap, of whatever templates, only the best is reported: most matched words less words that are missing.

Nulls: a null text is empty; null or repeated doc_ids are rows like any other; no template or an empty
table gives no rows. Long texts: time is linear in the words and the hits. Ties between matches go to the
one that begins first, then to the template's name. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 6, 0.6
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[A-Za-z0-9]+")

TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "EPL-2.0-notice": "Licensed under the Eclipse Public License, Version 2.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person "
        "obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or "
        "sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "MIT-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software "
        "for any purpose with or without fee is hereby granted."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or "
        "implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions"
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or "
        "organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, '
        "reproduce, display, distribute, execute, and transmit the "
        "Software, and to prepare derivative works of the Software"
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or "
        "modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0-or-later": (
        "This library is free software: you can redistribute it and/or "
        "modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available "
        "under the terms of the Eclipse Public License 2.0 which is "
        "available at"
    ),
    "BSD-3-Clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software "
        "for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice "
        "appear in all copies."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); '
        "you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed "
        'under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or "
        "modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or "
        "modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of "
        "the License, or (at your option) any later version."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or "
        "modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later "
        "version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla "
        "Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or "
        "without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public "
        "domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non- "
        "commercial, and by any means."
    ),
}


_CC = {"BY": "", "SA": "sharealike", "NC": "noncommercial", "ND": "noderivatives"}
_GNU = {"GPL": "", "LGPL": "lesser", "AGPL": "affero"}


def _rules() -> dict[str, tuple[frozenset[bytes], frozenset[bytes]]]:
    """Of templates with kin: words that the matched span must hold, and words that it must not."""
    out = {}
    for name in TEMPLATES:
        parts = set(name.split("-"))
        if name.startswith("CC-BY"):
            marks = lambda on: {w for k, v in _CC.items() if (k in parts) == on and k != "BY" for w in ([k.lower()] if name.endswith("notice") else [v])}  # noqa: B023, E731
            must, never = marks(True) | {"4"}, marks(False)
        elif (kin := name.split("-")[0]) in _GNU:
            must = {name.split("-")[1].split(".")[0], *([_GNU[kin]] if _GNU[kin] else []), *(["1"] if "2.1" in name else [])}
            never = set(_GNU.values()) - {_GNU[kin], ""}
        elif name.endswith("notice"):
            must, never = {name.split("-")[0].lower() if name[:3] not in ("MPL", "EPL", "CC0") else {"MPL": "mozilla", "EPL": "eclipse", "CC0": "waived"}[name[:3]]}, set()
            if name.startswith("BSD"):
                must |= {name.split("-")[1], "clause"}
            elif "2.0" in name:
                must |= {"2"}
        elif name == "ISC":
            must, never = {"notice"}, set()
        else:
            continue
        out[name] = (frozenset(x.encode() for x in must), frozenset(x.encode() for x in never))
    return out


RULES = _rules()


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


def winnow(keys: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: of every `window` neighbours the least hash, the rightmost of equals."""
    h = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (keys.astype(np.uint64) >> np.uint64(17))
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, dtype=np.int64)
    kept = {i + window - 1 - int(np.argmin(h[i : i + window][::-1])) for i in range(len(h) - window + 1)}
    return np.array(sorted(kept))


def extend(a: list, b: list, band: int) -> tuple[int, int, int, int]:
    """The best alignment of beginnings of a and b, within `band` of the main diagonal: (score, matched words, words of a, words of b).

    A match scores 2, a change -1, a gap -1; of equal scores the shortest.
    """
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    best = (2 * n, n, n, n)
    if n == len(a) or n == len(b):
        return best
    low = -(1 << 30)
    row = {d: (2 * n - abs(d), n) for d in range(-min(band, n), band + 1)}  # j - i -> score, matched, at i = n
    row = {d: v for d, v in row.items() if d >= 0}
    for i in range(n, len(a)):
        new: dict[int, tuple[int, int]] = {}
        for d in range(-band, band + 1):
            j = i + d
            if not -1 <= j < len(b):
                continue
            s, m = row.get(d, (low, 0))
            cell = (low, 0)
            if j >= 0 and s > low:
                cell = (s + 2, m + 1) if a[i] == b[j] else (s - 1, m)
            if (up := row.get(d + 1)) is not None and up[0] - 1 > cell[0]:
                cell = (up[0] - 1, up[1])
            if (side := new.get(d - 1)) is not None and side[0] - 1 > cell[0]:
                cell = (side[0] - 1, side[1])
            if cell[0] > low:
                new[d] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], i + 1, j + 1)
        row = new
    return best


class Index:
    def __init__(self, templates: dict[str, str], rules: dict[str, tuple[frozenset[bytes], frozenset[bytes]]] | None = None):
        self.names, self.words, self.rules = [], [], RULES if rules is None else rules
        for name, text in sorted(templates.items()):
            w = words_of(text.encode())
            if len(w) >= GRAM:
                self.names.append(name)
                self.words.append(w)
        self.ids = {w: i for i, w in enumerate(sorted({x for t in self.words for x in t}))}
        places: dict[int, list[tuple[int, int]]] = {}
        for t, w in enumerate(self.words):
            keys = self.grams(np.array([self.ids[x] for x in w]))
            for p in winnow(keys, WINDOW).tolist():
                places.setdefault(int(keys[p]), []).append((t, p))
        self.places = places
        self.keys = np.array(sorted(places), dtype=np.int64)

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Keys of the GRAM-grams; -1 where a word is in no template."""
        n = len(ids) - GRAM + 1
        if n < 1:
            return np.zeros(0, dtype=np.int64)
        key, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for k in range(GRAM):
            part = ids[k : k + n]
            key = key * (len(self.ids) + 1) + part
            known &= part >= 0
        return np.where(known, key, -1)

    def scan(self, text: str, coverage: float = COVERAGE) -> list[tuple[str, int, int, float, int, int]]:
        """(template, matched words, template words, coverage, start, end) in the order of places."""
        words = words_of(text.encode())
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        keys = self.grams(ids)
        if not len(self.keys) or not len(keys):
            return []
        at = np.flatnonzero(keys >= 0)
        if not len(at):
            return []
        near = np.searchsorted(self.keys, keys[at])
        near[near == len(self.keys)] = 0
        at = at[self.keys[near] == keys[at]]
        if not len(at):
            return []
        # candidates: hits of a template near one diagonal that go forward in it
        candidates: list[list[tuple[int, int]]] = []
        open_: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for p in at.tolist():
            for t, q in self.places[int(keys[p])]:
                k = (p - q) // BAND
                for x in (k, k - 1, k + 1):
                    c = open_.get((t, x))
                    if c is not None and c[-1][1] < q and abs(p - q - c[-1][0] + c[-1][1]) <= BAND:
                        c.append((p, q))
                        break
                else:
                    open_[t, k] = c = [(t, -1), (p, q)]
                    candidates.append(c)
        found = set()
        for c in candidates:
            t, (p, q) = c[0][0], c[1 + (len(c) - 1) // 2]
            a, lo = self.words[t], p - q
            if lo >= 0 and words[lo : lo + len(a)] == a:
                m, s, e = len(a), lo, lo + len(a)
            else:
                reach = 2 * BAND
                _, after, _, z = extend(a[q:], words[p : p + len(a) - q + reach], reach)
                _, before, _, y = extend(a[:q][::-1], words[max(0, p - q - reach) : p][::-1], reach)
                m, s, e = before + after, p - y, p + z
            if m >= coverage * len(a) and self.allowed(t, words[s:e]):
                found.add((len(a) - 2 * m, s, self.names[t], e, m, len(a)))
        if not found:
            return []
        best = common.disjoint((s, e, name, m, n) for _, s, name, e, m, n in sorted(found))
        spans = [m.span() for m in _WORD.finditer(text)]
        return [(name, m, n, m / n, spans[s][0], spans[e - 1][1]) for s, e, name, m, n in best]

    def allowed(self, t: int, span: list[bytes]) -> bool:
        """Whether the span holds the words that tell the template from its kin, and none of its kin's."""
        must, never = self.rules.get(self.names[t], (frozenset(), frozenset()))
        return must.issubset(span) and never.isdisjoint(span)


MATCHES = "doc_id long, license string, matched_words long, template_words long, coverage double, start long, end long"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """MATCHES for docs(doc_id, text). templates: name -> text, a table that the caller holds in memory."""
    templates = TEMPLATES if templates is None else templates
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in MATCHES.split(", ")])

    def run(batches):
        index = Index(templates)
        for b in batches:
            rows = [(d, *hit) for d, t in zip(b.column("doc_id").to_pylist(), common.texts_of(b.column("text"))) for hit in index.scan(t, coverage)]
            if rows:
                yield common.batch_of(schema, list(zip(*rows)))

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, MATCHES)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
