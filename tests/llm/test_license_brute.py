"""Licence notices against a plain aligner over all templates and all stretches of the text."""

import random

import pytest
import zstandard

from gleanworks.llm import license_scan


def words_of(text):
    plain = license_scan._LEADER.sub(lambda m: " " * len(m[0]), text)
    return [(m.start(), m.end(), m[0].lower()) for m in license_scan._WORD.finditer(plain)]


def distance(a, b):
    """Words to leave out of either so that both are the same."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else min(row[j], new[-1]) + 1)
        row = new
    return row[-1]


def brute(text):
    """(licence, words that differ) of the stretches that are closest to a template, each stretch of words for each
    template, chosen as the docstring says: of two that share words the one that saves more bytes, of equal ones the closer,
    of those of one licence the longer."""
    words = words_of(text)
    every = []
    for name, texts in license_scan.TEMPLATES.items():
        for t in texts:
            found = []
            template = [w for _, _, w in words_of(t)]
            if sum(w in {w for _, _, w in words} for w in template) < (1 - license_scan.MAX_DIFFERENT) * len(template):
                continue
            limit = int(license_scan.MAX_DIFFERENT * len(template))
            for a in range(len(words)):
                if words[a][2] not in template:
                    continue
                for b in range(a + max(1, len(template) - limit), min(len(words), a + len(template) + limit) + 1):
                    if words[b - 1][2] not in template:
                        continue
                    n = distance(template, [w for _, _, w in words[a:b]])
                    if n <= license_scan.MAX_DIFFERENT * len(template) and license_scan._TRIGGER.search(text[words[a][0] : words[b - 1][1]]):
                        found.append((n / len(template), b - a, n, a, b))
            # of one template's stretches that share words the closest
            own = []
            for share, size, n, a, b in sorted(found):
                if all(min(b, r[4]) <= max(a, r[3]) for r in own):
                    own.append((share, size, n, a, b))
            bare = t in license_scan._bare(name)
            every += [(bare, -plainly_saved(t, [w for _, _, w in words[a:b]]), share, -len(template), name, n, a, b) for share, _, n, a, b in own]
    named = []
    for bare, saved, share, _, name, n, a, b in sorted(every):
        rivals = [r for r in named if min(b, r[3]) - max(a, r[2]) > 0.5 * min(b - a, r[3] - r[2])]
        if all(r[4] == (bare, saved, share) and r[0] != name for r in rivals) and not (bare and any(r[0] == name and not r[4][0] for r in named)):
            named.append((name, n, a, b, (bare, saved, share)))
    return sorted((name, n) for name, n, *_ in named)


def plainly_saved(template, words):
    """Bytes that the library saves on these words when it has the template as raw dictionary."""
    raw, content = " ".join(words).encode(), " ".join(w for _, _, w in words_of(template)).encode().rjust(64, b"\0")
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = lambda **k: len(zstandard.ZstdCompressor(level=license_scan.LEVEL, write_content_size=False, **k).compress(raw))
    return press() - press(dict_data=d, write_dict_id=False)


FILLER = "the cat sat on a mat near an old house where nobody had been for years and years".split()


def wrapped(text, width, leader):
    lines, line = [], leader
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line.rstrip())
            line = leader
        line += w + " "
    return "\n".join([*lines, line.rstrip()])


@pytest.mark.parametrize("seed", range(12))
def test_equals_a_plain_aligner(seed):
    """Exact and changed notices, hard-wrapped behind comment leaders, side by side and between other words."""
    rng = random.Random(seed)
    parts = []
    for name in rng.sample(sorted(license_scan.TEMPLATES), 3):
        words = rng.choice([t for t in license_scan.TEXTS[name] if len(t) < 400]).split()
        for _ in range(rng.choice([0, 0, 1, 2]) if len(words) > 12 else 0):
            words[rng.randrange(len(words))] = rng.choice(FILLER)
        parts.append(" ".join(words))
        parts.append(" ".join(rng.choices(FILLER, k=rng.choice([0, 3, 30]))))
    text = wrapped(" ".join(parts), 76, rng.choice(["", "# ", " * ", "// ", "rem "]))
    assert sorted((name, n) for _, _, name, n, *_ in license_scan.notices(text)) == brute(text)


def test_bytes_saved_rank_before_words():
    """A misspelt word is two differences from the right licence and one from the wrong one, and the bytes tell."""
    text = "This work is licensed under the GNU Lessr General Public License, version 3."
    assert [(n[2], n[3]) for n in license_scan.notices(text)] == [("LGPL-3.0", 2)]


@pytest.mark.parametrize(("text", "name"), [("MIT License", "MIT"), ("Licensed under MIT.", "MIT"), ("# SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("Licensed under the EUPL 1.2.", "EUPL-1.2"), ("see the ISC license", "ISC")])
def test_short_forms(text, name):
    assert [n[2:4] for n in license_scan.notices(text)] == [(name, 0)]


def test_full_texts_are_one_notice():
    for name, texts in license_scan.TEXTS.items():
        assert [n[2:4] for n in license_scan.notices("x = 1\n" + wrapped(max(texts, key=len), 72, "# "))] == [(name, 0)]


def test_a_name_belongs_to_its_notice():
    text = "MIT License\n\n" + license_scan.TEXTS["MIT"][2]
    assert [n[2:4] for n in license_scan.notices(text)] == [("MIT", 0)]


def test_all_templates_in_one_block():
    text = "\n".join(texts[0] for texts in license_scan.TEMPLATES.values())
    assert {n[2] for n in license_scan.notices(text)} == set(license_scan.TEMPLATES)


def test_empty_and_repeated_rows(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, None), (3, ""), (None, "Licensed under the MIT License.")]
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, start int, license string")
    got = sorted((r.doc_id or 0, r.license) for r in license_scan.license_scan(docs).collect())
    assert got == [(0, "MIT"), (1, "MIT"), (1, "MIT")]
    assert license_scan.license_scan(docs.where("false")).collect() == []
