"""License scans by MinHash bands over overlapping text windows (operator 7).

A template of ``n`` five-word shingles belongs to the class of the next power of two, ``c``.
Windows of 2c shingles that overlap by c cover every text, so a whole notice lies inside
one.  If ``share`` of a template's shingles are in a window, their Jaccard similarity is at
least ``m / (2c + n - m)`` with m = ceil(share * n), and bands of one MinHash each meet with
that chance: their number is set so that all bands miss with a probability below ``miss``.
A window retrieved by any band is verified exactly: the share of the template's shingles in
it.  Each block minimum is made of the two of the class below, so all classes share one pass
of every MinHash.  Templates are some hundreds and fixed in size, so each task holds them and
no text is shuffled.

A template of one shingle is looked up exactly, and so is one of fewer than ``width`` words,
by the one shingle of its own length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dealgrid.llm.common import in_tasks, text_only
from dealgrid.llm.license_texts import TEXTS
from dealgrid.llm.text import mix64, windows, word_hashes

MISS = 1e-3
SHARE = (80, 100)

# License notices that are looked for.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                 "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
                    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
}

# Standard notices of files, and whole texts.
NOTICES = {
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                         "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
                         "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                         "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                         "governing permissions and limitations under the License.",
    "ASF-header": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file "
                  "distributed with this work for additional information regarding copyright ownership.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                      "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which "
                      "is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSD-header": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT-header": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at "
                  "https://opensource.org/licenses/MIT.",
    "GPL-copy": "You should have received a copy of the GNU General Public License along with this program. If not, see "
                "<https://www.gnu.org/licenses/>.",
    "Public-domain": "This work has been released into the public domain by its author.",
    **{f"{kind}{version}-header": f"This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {title} as "
                                  f"published by the Free Software Foundation; either version {version} of the License, or (at your option) any "
                                  f"later version."
       for kind, work, title, versions in (("GPL-", "program", "General Public License", ("2", "3")),
                                           ("LGPL-", "library", "Lesser General Public License", ("2.1", "3")),
                                           ("AGPL-", "program", "Affero General Public License", ("3",))) for version in versions},
    **{f"{name}-text": text for name, text in TEXTS.items()},
}

# Citations of one line, each with and without a full stop: a license is named after a verb.
VERBS = ("Released", "Licensed", "Distributed", "Published", "Provided", "Available")
CITED = {
    "MIT": ("the MIT License", "the MIT license (MIT)"), "ISC": ("the ISC License",), "Zlib": ("the zlib License",),
    "Apache-2.0": ("the Apache License 2.0", "the Apache 2.0 License", "the Apache License, Version 2.0", "the Apache-2.0 License"),
    "BSD": ("the BSD License", "a BSD-style license"), "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"),
    "GPL-2.0": ("the GPL v2", "the GPLv2 license", "the GNU GPL version 2"), "GPL-3.0": ("the GPL v3", "the GPLv3 license", "the GNU GPL version 3"),
    "GPL": ("the GNU General Public License", "the GPL license"), "LGPL": ("the GNU Lesser General Public License", "the LGPL license"),
    "AGPL": ("the GNU Affero General Public License", "the AGPL license"), "MPL-2.0": ("the Mozilla Public License 2.0", "the Mozilla Public License, v. 2.0"),
    "EPL-2.0": ("the Eclipse Public License 2.0",), "BSL-1.0": ("the Boost Software License, Version 1.0",), "Unlicense": ("the Unlicense license",),
    "CC0-1.0": ("the CC0 1.0 license", "CC0 1.0 Universal"), "GFDL": ("the GNU Free Documentation License",), "ODbL": ("the Open Database License",),
    **{f"CC-{part}-{version}": (f"CC {part} {version}", f"the CC {part} {version} license", f"a Creative Commons {words} {version} {place} License")
       for part, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                           ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
       for version, place in (("3.0", "Unported"), ("4.0", "International"))},
}
SPDX = ("MIT", "MIT-0", "ISC", "Zlib", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only",
        "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0",
        "EPL-2.0", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense")


def _citations() -> dict[str, str]:
    """Name -> line, of the lines that are no notice above."""
    lines = {f"{name} ({verb.lower()} under {what}{stop})": f"{verb} under {what}{stop}"
             for name, names in CITED.items() for what in names for verb in VERBS for stop in (".", "")}
    lines |= {f"{name} (SPDX)": f"SPDX-License-Identifier: {name}" for name in SPDX}
    lines |= {f"Reserved ({x})": x for x in ("All rights reserved.", "All rights reserved", "All rights reserved;", "All rights reserved,")}
    known = {text.lower() for text in TEMPLATES.values()}
    return {name: text for name, text in lines.items() if text.lower() not in known}


REGISTERED = {**TEMPLATES, **NOTICES, **_citations()}


def needed(n: int, share: tuple[int, int] = SHARE) -> int:
    return max(1, -(-n * share[0] // share[1]))


def bands(n: int, c: int, share: tuple[int, int], miss: float) -> int:
    """MinHashes of which all miss a matching window with a probability below ``miss``."""
    m = needed(n, share)
    j = m / (2 * c + n - m)
    return 1 if j >= 1 else math.ceil(math.log(miss) / math.log(1 - j))


def _permuted(shingles: np.ndarray, band: int) -> np.ndarray:
    return mix64(shingles ^ np.uint64((0xA24BAED4963EE407 * (band + 1)) & (1 << 64) - 1))


def _equals(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in values, place in the sorted keys) of all equal pairs."""
    low = np.searchsorted(keys, values)
    at = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == values)
    low, size = low[at], np.searchsorted(keys, values[at], side="right") - low[at]
    return np.repeat(at, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size)


class Templates:
    def __init__(self, texts: dict[str, str], width: int = 5, share: tuple[int, int] = SHARE, miss: float = MISS):
        self.width, self.share = width, share
        self.names, self.sets = [], []
        single: dict[int, list[int]] = {}  # templates of one shingle, by its length in words
        self.classes: dict[int, list[int]] = {}
        for name, text in sorted(texts.items()):
            for _, _, hashes, counts in word_hashes(pa.array([text])):
                length = min(width, int(counts[0]))
                s = np.unique(windows(hashes, counts, max(1, length))[0])
                if len(s):
                    if len(s) == 1:
                        single.setdefault(length, []).append(len(self.names))
                    else:
                        self.classes.setdefault(1 << (len(s) - 1).bit_length(), []).append(len(self.names))
                    self.names.append(name)
                    self.sets.append(s)
        self.classes = dict(sorted(self.classes.items()))
        self.bands = {c: max(bands(len(self.sets[i]), c, share, miss) for i in own) for c, own in self.classes.items()}
        self.single = {length: self._sorted(own, lambda s: s[0]) for length, own in single.items()}
        self.lows = {(c, b): self._sorted(own, lambda s: _permuted(s, b).min()) for c, own in self.classes.items() for b in range(self.bands[c])}

    def _sorted(self, own: list[int], key) -> tuple[np.ndarray, np.ndarray]:
        """(sorted keys, their templates)."""
        keys = np.array([key(self.sets[i]) for i in own], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        return keys[order], np.array(own)[order]

    def places(self, hashes: np.ndarray, counts: np.ndarray):
        """Yields (row, template, first word in the row, share) of all matches in a chunk's words."""
        for length, (keys, own) in self.single.items():
            shingles, number = windows(hashes, counts, length)
            row, begin = np.repeat(np.arange(len(number)), number), np.cumsum(number) - number
            for at, j in zip(*_equals(shingles, keys)):
                yield int(row[at]), int(own[j]), int(at - begin[row[at]]), 1.0
        shingles, number = windows(hashes, counts, self.width)
        yield from self.scan(shingles, np.repeat(np.arange(len(number)), number), np.cumsum(number))

    def scan(self, shingles: np.ndarray, row: np.ndarray, ends: np.ndarray):
        """Yields (row, template, first shingle in the row, share) of templates of two shingles or more."""
        if not len(shingles):
            return
        # Blocks of c shingles, counted from each text's begin; a window is a block and the next.
        begin = np.concatenate(([0], ends[:-1]))
        at = np.arange(len(row))
        levels, marked = [], {}
        for c in self.classes:
            blocks = np.flatnonzero((at - begin[row[at]]) % c == 0)  # of the blocks below, those that begin one
            at = at[blocks]
            follows = np.flatnonzero(row[at[1:]] == row[at[:-1]])
            levels.append((c, blocks, at, follows))
            marked[c] = []
        for b in range(max(self.bands.values(), default=0)):
            low = _permuted(shingles, b)
            for c, blocks, _, follows in levels:
                low = np.minimum.reduceat(low, blocks)
                if b < self.bands[c]:
                    window = low.copy()
                    window[follows] = np.minimum(low[follows], low[follows + 1])
                    keys, own = self.lows[c, b]
                    w, j = _equals(window, keys)
                    if len(w):
                        marked[c].append(w * len(self.names) + own[j])
        for c, _, first, _ in levels:
            found: dict[tuple[int, int, int], float] = {}  # a place may begin in a window and end in the next
            for code in (np.unique(np.concatenate(marked[c])).tolist() if marked[c] else ()):
                w, i = divmod(code, len(self.names))
                a, r = int(first[w]), int(row[first[w]])
                window = shingles[a:min(a + 2 * c, int(ends[r]))]
                held = np.flatnonzero(np.isin(window, self.sets[i]))
                got = len(np.unique(window[held]))
                if got * self.share[1] >= self.share[0] * len(self.sets[i]):
                    key = (r, i, a + int(held[0]) - int(begin[r]))
                    found[key] = max(found.get(key, 0.0), got / len(self.sets[i]))
            for key, part in found.items():
                yield *key, part


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None, width: int = 5, share: tuple[int, int] = SHARE,
                  miss: float = MISS) -> DataFrame:
    """(doc_id, license, containment, start_word, n_places): license notices in documents.

    One row for each input row and template of which a window of the text holds ``share`` of the
    distinct shingles: the largest share found, the first word of that place (the first of
    equals), and the number of places.  Null and empty texts hold nothing; a template of under
    ``width`` words is held where these words follow one another.  Null doc_ids and repeated rows are
    kept as they come; an empty table gives no rows; extra columns are ignored."""
    shared = in_tasks(docs.sparkSession, Templates(REGISTERED if texts is None else texts, width, share, miss))

    def run(batches):
        templates = shared()
        for batch in batches:
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for lo, _, hashes, counts in word_hashes(batch.column(1)):
                for r, i, at, part in templates.places(hashes, counts):
                    was = best.get((lo + r, i), (0.0, 0, 0))
                    best[lo + r, i] = (*((part, -at) if (part, -at) > was[:2] or not was[2] else was[:2]), was[2] + 1)
            rows = [(batch.column(0)[r].as_py(), templates.names[i], part, -at, n) for (r, i), (part, at, n) in sorted(best.items())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in rows], t) for k, t in enumerate([pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()])],
                ["doc_id", "license", "containment", "start_word", "n_places"])
    return text_only(docs).mapInArrow(run, "doc_id long, license string, containment double, start_word long, n_places long")
