"""Many tags on one line, notices by version, exceptions; labels against a plain search."""

from __future__ import annotations

import random
import re
import time

from panelforge.llm import licenses


def scanned(text):
    return licenses.scan(licenses.automaton(), text.encode())


def test_tags_on_one_line_take_time_in_proportion():
    def took(n):
        text = ("x SPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0) " * n).encode()
        finder = licenses.automaton()
        began = time.process_time()
        row = licenses.scan(finder, text)
        assert len(row[6]) == n
        return time.process_time() - began

    took(500)
    small, large = min(took(4000) for _ in range(2)), took(40_000)
    assert large < 20 * small + 0.5


def test_expressions_end_where_they_did():
    for text, rpn in (
        ("SPDX-License-Identifier: MIT OR SPDX-License-Identifier: ISC", ["MIT SPDX-License-Identifier or", "ISC"]),
        ("SPDX-License-Identifier: MIT AND\nISC", ["MIT"]),
        ("SPDX-License-Identifier: MIT, SPDX-License-Identifier :\tISC or 0BSD x", ["MIT", "ISC 0BSD or"]),
    ):
        assert scanned(text)[6] == rpn


def test_exceptions_that_are_known_and_that_are_not():
    known, other = scanned("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0"), scanned("SPDX-License-Identifier: GPL-2.0 WITH Foo-bar")
    assert known[5] == "gpl-2" and known[7] == [] and known[9] == "weak copyleft" and known[10] == 1.0
    assert other[5] == "gpl-2" and other[7] == ["Foo-bar"] and other[9] is None and other[10] < 1.0
    for name, label in (("GPL-1.0-only", "gpl-1"), ("MS-PL", "ms-pl"), ("Artistic-2.0", "artistic-2"), ("BSD-4-Clause", "bsd-4-clause"), ("OFL-1.1", "ofl-1"), ("EUPL-1.2", "eupl-1")):
        row = scanned(f"SPDX-License-Identifier: {name}")
        assert (row[5], row[7]) == (label, [])


def test_versions_in_plain_words():
    for text, label in (("under GPL 3 or later", "gpl-3"), ("GPLv2.", "gpl-2"), ("the GNU GPL, version 3", "gpl-3"), ("MPL v2", "mpl-2"), ("Eclipse Public License 1.0", "epl-1"), ("a 3-clause BSD license", "bsd-3-clause"), ("two clause bsd", "bsd-2-clause"), ("the Artistic License 2.0", "artistic-2")):
        assert scanned(text)[5] == label, text


def test_labels_equal_a_plain_search():
    """Of notices within one another the longest stands; all others give their label."""
    table = licenses.phrases()
    r = random.Random(4)
    names = list(table)
    for _ in range(150):
        bag = [r.choice(names + ["word", "version", "2", "cc", "by", "license", "gpl"]) for _ in range(12)]
        words = " ".join(bag).split()
        found = []
        for phrase, label in table.items():
            p = phrase.split()
            found += [(i, i + len(p), label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        labels, reach = {label for a, b, label in found if label in licenses.BASE.values() and " ".join(words[a:b]) in licenses.BASE}, -1
        for _, end, label in sorted(found, key=lambda f: (f[0], -f[1])):
            if end > reach:
                labels.add(label)
                reach = end
        assert scanned(re.sub(" ", "-", " ".join(words)))[5] == ",".join(sorted(labels))
