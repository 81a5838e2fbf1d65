"""Operator 2: licence notices by conditional compression: the template that saves the most bytes as dictionary wins.

Line feeds and comment leaders are white space: candidate blocks are the stretches of words, around a word that licences
use, on which some template may lie, wherever the notice begins and ends and however it is wrapped. Each template that
competes for a block has its stretch compressed on its own and with the template as zstandard raw-content dictionary; the
one that saves the most bytes is named, if the exact wording confirms it: few enough words may differ.

Texts without such a word are discarded by a built-in expression before Python sees a row, and scanning is a map without
a shuffle; the templates are fixed and small. The work grows with the words of the text, not with their square.
"""

from __future__ import annotations

import bisect
import collections
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Full texts, short notices and first sentences of licences, by SPDX identifier.
TEXTS: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "EUPL-1.2": ["Licensed under the EUPL 1.2."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "Artistic-2.0": ["Licensed under the Artistic License 2.0."],
    "CDDL-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License"],
    "proprietary": ["All rights reserved."],
}
#: What licences are called, beside their identifiers.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0"],
    "GPL-3.0": ["GPLv3", "GNU General Public License, version 3", "GNU General Public License v3.0"],
    "GPL-2.0": ["GPLv2", "GNU General Public License, version 2", "GNU General Public License v2.0"],
    "LGPL-3.0": ["LGPLv3", "GNU Lesser General Public License v3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License v2.1"],
    "AGPL-3.0": ["AGPLv3", "GNU Affero General Public License v3.0"],
    "MPL-2.0": ["Mozilla Public License 2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License 1.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "EUPL v1.2"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "OFL-1.1": ["SIL Open Font License 1.1"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0"],
    "CC0-1.0": ["CC0 1.0 Universal"],
}


def _bare(name: str) -> list[str]:
    """A licence's names alone, where they hold a word of TRIGGER: a heading, or a mention."""
    return [n for n in NAMES.get(name, ()) if re.search(r"(?i)licen[sc]e", n)]


def _forms(name: str) -> list[str]:
    """Short forms by rule: the tag of a source file, and the usual clauses with each name; those of TEXTS come first."""
    if name == "proprietary":
        return TEXTS[name]
    called = NAMES.get(name, []) + ([] if name == "Unlicense" else [name])
    named = [f"{verb} under {the}{n}." for n in called for verb in ("Licensed", "Released") for the in ("", "the ")]
    # GPL identifiers end in -only and -or-later as well
    tags = [f"SPDX-License-Identifier: {name}{end}" for end in (("", "-only", "-or-later") if "GPL" in name else ("",))]
    return list(dict.fromkeys(TEXTS[name] + named + tags))


#: Every template, by licence.
TEMPLATES: dict[str, list[str]] = {name: _forms(name) + _bare(name) for name in TEXTS}
#: Words of which a notice has one.
TRIGGER = r"(?i)licen[sc]|copyright|all\W+rights\W+reserved|redistribut|public\W+domain|permission\W+(?:is\W+hereby|to\W+use)|terms\W+of\W+the|free\W+software"
_TRIGGER = re.compile(TRIGGER)
_WORD = re.compile(r"\w+(?:[.\-]\w+)*")
#: Comment leaders that are words; all others are not.
_LEADER = re.compile(r"(?im)^[ \t]*(?:rem|dnl)(?=[ \t])")
#: What closes a sentence belongs to its last word.
_CLOSE = re.compile(r"[\"')\]]*[.:;!?]?")
LEVEL = 19
#: The share of words of a template that may differ.
MAX_DIFFERENT = 0.25
SCHEMA = "doc_id long, start long, end long, license string, n_different long, n_template_words long, exact boolean, bytes_alone long, bytes_saved long, block string"


@functools.lru_cache(maxsize=1)
def _presses():
    alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    names, words, presses, bare = [], [], [], []
    for name, texts in TEMPLATES.items():
        for text in texts:
            names.append(name)
            words.append(_WORD.findall(text.lower()))
            bare.append(text in _bare(name))
            # As in the blocks: words in lower case, one space apart. Zeros before a short one fill the least dictionary.
            content = " ".join(words[-1]).encode().rjust(64, b"\0")
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            presses.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
    known = {w: i for i, w in enumerate(dict.fromkeys(w for t in words for w in t))}
    rows = np.full((len(words), max(map(len, words))), -2, dtype=np.int64)
    for row, t in zip(rows, words, strict=True):
        row[: len(t)] = [known[w] for w in t]
    return alone, names, rows, np.array(list(map(len, words))), presses, known, bare


def _regions(text: str, spans: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """(first, last + 1) words within ``reach`` words of a trigger; overlapping ones are joined."""
    starts, found = [a for a, _ in spans], []
    for m in _TRIGGER.finditer(text):
        at = bisect.bisect_right(starts, m.start()) - 1
        a, b = max(0, at - reach), min(len(spans), at + reach + 1)
        if found and a <= found[-1][1]:
            found[-1][1] = b
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def _ends(words: np.ndarray) -> Iterator[tuple[int, int]]:
    """(template, last word) of all places in ``words`` where a template ends with at most its share of differences.

    The distance counts words of the template that are missing and words of the text that are between; where it begins
    is free. Templates of which too many words are nowhere in ``words`` are left out, as none of their places can count.
    """
    _, _, templates, sizes, *_ = _presses()
    some = np.flatnonzero((np.isin(templates, words).sum(axis=1)) >= sizes * (1 - MAX_DIFFERENT))
    if not len(some):
        return
    width = sizes[some].max()
    t, at = templates[some][:, :width], np.arange(width + 1)
    now = np.tile(at, (len(some), 1))
    last, rows = sizes[some], np.arange(len(some))
    ends = np.empty((len(words) + 2, len(some)), dtype=np.int64)
    ends[0] = ends[-1] = last
    for j, w in enumerate(words, 1):
        new = now + 1
        new[:, 0] = 0
        np.minimum(new[:, 1:], np.where(t == w, now[:, :-1], width + 1), out=new[:, 1:])
        now = np.minimum.accumulate(new - at, axis=1) + at
        ends[j] = now[rows, last]
    here = ends[1:-1]
    good = (here <= MAX_DIFFERENT * last) & (here < ends[:-2]) & (here <= ends[2:])
    for j, k in np.argwhere(good):
        yield int(some[k]), int(j)


def _aligned(template: list[int], words: list[int]) -> tuple[int, list[int]]:
    """Words that differ, and the positions in ``words`` of those that are the same, of the closest alignment that ends
    with the last of ``words``; of equally close ones the shortest."""
    t, w = template[::-1], words[::-1]
    table = [list(range(len(w) + 1))]
    for i, x in enumerate(t, 1):
        row, up = [i], table[-1]
        for m, y in enumerate(w, 1):
            row.append(up[m - 1] if x == y else min(up[m], row[m - 1]) + 1)
        table.append(row)
    m = min(range(len(w) + 1), key=lambda m: table[-1][m])
    n, i, same = table[-1][m], len(t), []
    while i and m:
        if t[i - 1] == w[m - 1]:
            i, m = i - 1, m - 1
            same.append(len(w) - 1 - m)
        elif table[i][m] == table[i - 1][m] + 1:
            i -= 1
        else:
            m -= 1
    return n, same


def reduction(words: list[str], template: int) -> tuple[int, int]:
    """(bytes alone, bytes saved with the template as dictionary) of a block, read as its words in lower case."""
    alone, _, _, _, presses, *_ = _presses()
    raw = " ".join(words).lower().encode()
    size = len(alone.compress(raw))
    return size, size - len(presses[template].compress(raw))


def notices(text: str) -> list[tuple[int, int, str, int, int, int, int]]:
    """(start, end, licence, words that differ, words of the template, bytes alone, bytes saved) in text order.

    Templates compete where they align with the same words of the text: of two that share more than half the words of one
    of them the one that saves more bytes is named, of equal ones the closer in wording, of those of one licence the longer;
    two licences equal in both are both named. A name alone is no notice where its licence has another one nearby.
    """
    _, names, templates, sizes, _, known, bare = _presses()
    plain = _LEADER.sub(lambda m: " " * len(m[0]), text)
    spans = [m.span() for m in _WORD.finditer(plain)]
    named = []
    for a, b in _regions(plain, spans, int(sizes.max() * (1 + MAX_DIFFERENT)) + 1):
        found = []
        read = [plain[x:y].lower() for x, y in spans[a:b]]
        words = np.array([known.get(w, -1) for w in read], dtype=np.int64)
        for k, j in _ends(words):
            size = int(sizes[k])
            first = max(0, j + 1 - int(size * (1 + MAX_DIFFERENT)))
            n, same = _aligned(templates[k, :size].tolist(), words[first : j + 1].tolist())
            start, end = spans[a + first + same[0]][0], spans[a + j][1]
            if _TRIGGER.search(plain[start:end]):
                alone, saved = reduction(read[first + same[0] : j + 1], k)
                found.append((bare[k], -saved, n / size, -size, names[k], start, _CLOSE.match(text, end).end(), n, alone, [a + first + x for x in same]))
        named += _chosen(found)
    return sorted((start, end, name, n, -size, alone, -saved) for _, saved, _, size, name, start, end, n, alone, _ in named)


def _chosen(found: list[tuple]) -> list[tuple]:
    """Of the candidates of a region (bare, -bytes saved, share of differences, -words, licence, ..., positions of the same
    words) those that are named."""
    owners: dict[int, list[int]] = {}
    named: list[tuple] = []
    for x in sorted(found):
        shared = collections.Counter(i for w in x[-1] for i in owners.get(w, ()))
        rivals = [named[i] for i, n in shared.items() if 2 * n > min(len(x[-1]), len(named[i][-1]))]
        if all(r[:3] == x[:3] and r[4] != x[4] for r in rivals) and not (x[0] and any(not r[0] and r[4] == x[4] for r in named)):
            for w in x[-1]:
                owners.setdefault(w, []).append(len(named))
            named.append(x)
    return named


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the notices in the whole text."""
    return sorted({(a, b) for a, b, *_ in notices(text)})


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for a, b, name, n, total, size, saved in notices(text):
                rows.append((doc_id, a, b, name, n, total, n == 0, size, saved, text[a:b]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per licence confirmed in a block of ``docs(doc_id long, text, ...)``: doc_id, start, end (code points of
    the block, end exclusive), license, n_different, n_template_words, exact, bytes_alone, bytes_saved, block.

    Two licences whose words are equally close both get a row. A document without a confirmed notice, or with a null or
    empty text, has no row; a null doc_id stays null; repeated rows repeat their findings; other columns are ignored; an
    empty table gives an empty result. The whole text is scanned, however long.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(TRIGGER))
    return rows.mapInArrow(_scan, SCHEMA)
