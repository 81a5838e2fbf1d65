"""Licence notices that are wrapped, as in the head of a source file."""

import collections
import textwrap

from gleanworks.llm import license_scan

MIT = """MIT License

Copyright (c) 2020 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def found(spark, texts):
    got = collections.defaultdict(list)
    for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert texts[r.doc_id][r.start : r.end] == r.block and r.exact == (r.n_different == 0)
        got[r.doc_id].append((r.start, r.license, r.n_different))
    return [[x[1:] for x in sorted(got[i])] for i in range(len(texts))]


def test_wrapped_notices(spark):
    names = ["MIT", "BSD-3-Clause", "ISC", "GPL-3.0", "GPL-2.0", "Apache-2.0"]
    texts, expected = [MIT], [[("MIT", 0)]]
    for name in names:
        notice = max(license_scan.TEMPLATES[name], key=len)
        for lead in ("", "# ", " * ", "// ", "dnl "):
            texts.append("x = 1\n\n" + textwrap.fill(notice, 72, initial_indent=lead, subsequent_indent=lead) + "\n\ny = 2\n")
            expected.append([(name, 0)])
    assert found(spark, texts) == expected


def test_words_of_a_notice_on_two_lines(spark):
    assert found(spark, ["(c) me. All rights\n# reserved.\nx", "x\nreleased into the public\ndomain"]) == [[("proprietary", 0)], []]


def test_every_notice_of_a_list_is_named(spark):
    pick = ["MIT", "Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "GPL-3.0"]
    lines = [license_scan.TEMPLATES[n][0] for n in pick]
    every = [n for n in license_scan.TEMPLATES]
    texts = ["\n".join(lines), "Released under MIT license. All rights reserved.", "\n".join(license_scan.TEMPLATES[n][0] for n in every), "All rights reserved. " * 50]
    assert found(spark, texts) == [[(n, 0) for n in pick], [("MIT", 0), ("proprietary", 0)], [(n, 0) for n in every], [("proprietary", 0)] * 50]


def test_rivals_for_the_same_words(spark):
    agpl = "This work is licensed under the GNU Affero General Public License, version 3."
    assert found(spark, [agpl, agpl.replace("Affero ", ""), "This work is licensed under the GNU General Public License, version."]) == [[("AGPL-3.0", 0)], [("GPL-3.0", 0)], [("GPL-2.0", 1), ("GPL-3.0", 1)]]
