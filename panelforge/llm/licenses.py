"""License scans: Aho-Corasick for notices and identifier tags, shunting-yard for expressions.

One automaton holds all notice phrases and the identifier tag, as word sequences with a blank on
either side; one pass over a text's words finds them all. The expression after a tag is read from the
text itself, turned into postfix by a shunting-yard parser (``with`` binds tighter than ``and``,
``and`` tighter than ``or``) and evaluated: ``and`` asks for the stricter of two obligations, ``or``
leaves the choice of the laxer, ``with`` an exception makes a strong copyleft weak.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.text import slices

# Base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Further notices and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "this is free and unencumbered software released into the public domain": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "do what the fuck you want to public license": "wtfpl",
    "boost software license": "bsl-1",
    "sil open font license": "ofl-1",
    "server side public license": "sspl-1",
    "business source license": "busl-1",
    "all rights reserved": "all-rights-reserved",
}

# Names of licences that texts call by a version, and the versions; the label is the first name and the version.
VERSIONED = (
    (("gpl", "gnu gpl", "gnu general public license"), ("1", "2", "3")),
    (("mpl", "mozilla public license"), ("1", "2")),
    (("epl", "eclipse public license"), ("1", "2")),
    (("eupl", "european union public licence", "european union public license"), ("1",)),
    (("cddl", "common development and distribution license"), ("1",)),
    (("artistic", "artistic license", "perl artistic license"), ("1", "2")),
    (("osl", "open software license"), ("3",)),
    (("afl", "academic free license"), ("3",)),
)
# Clauses by which BSD licences are told apart.
CLAUSES = (("0", "zero"), ("2", "two"), ("3", "three"), ("4", "four"))

# Obligations from lax to strict, and the families of identifiers with theirs. A family's label is the notices' one.
LEVELS = ("permissive", "attribution", "weak copyleft", "strong copyleft", "network copyleft", "no derivatives", "noncommercial")
FAMILIES = {
    "mit": ("mit", 0), "mit-0": ("mit", 0), "0bsd": ("bsd", 0), "bsd-2-clause": ("bsd-2-clause", 0), "bsd-3-clause": ("bsd-3-clause", 0), "isc": ("isc", 0),
    "zlib": ("zlib", 0), "unlicense": ("public-domain", 0), "cc0": ("cc0", 0), "bsl-1": ("bsl-1", 0), "wtfpl": ("wtfpl", 0), "x11": ("x11", 0), "ncsa": ("ncsa", 0),
    "postgresql": ("postgresql", 0), "curl": ("curl", 0), "upl-1": ("upl-1", 0), "python-2": ("python-2", 0), "psf-2": ("python-2", 0), "ms-pl": ("ms-pl", 0), "afl-3": ("afl-3", 0),
    "apache-2": ("apache-2", 1), "apache-1": ("apache-1", 1), "apache-1.1": ("apache-1", 1), "bsd-4-clause": ("bsd-4-clause", 1), "openssl": ("openssl", 1), "cc-by": ("cc-by", 1), "ofl-1.1": ("ofl-1", 1), "ofl-1": ("ofl-1", 1),
    "lgpl": ("lgpl", 2), "mpl-1": ("mpl-1", 2), "mpl-1.1": ("mpl-1", 2), "mpl-2": ("mpl-2", 2), "epl-1": ("epl-1", 2), "epl-2": ("epl-2", 2), "cc-by-sa": ("cc-by-sa", 2), "cddl-1": ("cddl-1", 2), "cddl-1.1": ("cddl-1", 2),
    "artistic-1": ("artistic-1", 2), "artistic-2": ("artistic-2", 2), "ms-rl": ("ms-rl", 2), "cpl-1": ("cpl-1", 2), "eupl-1.1": ("eupl-1", 3), "eupl-1.2": ("eupl-1", 3), "osl-3": ("osl-3", 4),
    "gpl-1": ("gpl-1", 3), "gpl-2": ("gpl-2", 3), "gpl-3": ("gpl-3", 3), "agpl": ("agpl", 4), "sspl-1": ("sspl-1", 4), "cc-by-nd": ("cc-by-nd", 5),
    "cc-by-nc": ("cc-by-nc", 6), "cc-by-nc-sa": ("cc-by-nc-sa", 6), "cc-by-nc-nd": ("cc-by-nc-nd", 6), "busl-1.1": ("busl-1", 6), "busl-1": ("busl-1", 6),
}
# Exceptions after ``with`` that make a strong copyleft weak.
EXCEPTIONS = (
    "autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 ecos-exception-2.0 fltk-exception font-exception-2.0 "
    "freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gnu-javamail-exception i2p-gpl-java-exception libtool-exception linux-syscall-note llvm-exception "
    "nokia-qt-exception-1.1 ocaml-lgpl-linking-exception openjdk-assembly-exception-1.0 openssl-exception qt-gpl-exception-1.0 qt-lgpl-exception-1.1 qwt-exception-1.0 "
    "swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1"
).split()
_STRONG, _WEAK = 3, 2

TAG = "spdx license identifier"
_TAG = re.compile(rb"spdx-license-identifier\s*:", re.IGNORECASE)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*|[^\s]")
_RANK = {"or": 1, "and": 2, "with": 3}

#: A-Z to a-z, and everything that is in no word to a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the longest well-formed licence expression at the start, in postfix; None if there is none."""
    out: list[str] = []
    stack: list[str] = []
    expect = True
    for m in _TOKEN.finditer(expression):  # as far as the expression goes, not the line
        token = m[0]
        word = token.lower()
        if expect:
            if token == "(":
                stack.append(token)
            elif word in _RANK or not token[0].isalnum():
                break
            else:
                out.append(token)
                expect = False
        elif word in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            expect = True
        elif token == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
    if not out or expect or "(" in stack:
        return [out[0]] if out else None
    return out + stack[::-1]


def family(identifier: str) -> tuple[str, int] | None:
    """Label and obligation of an identifier, whatever its version's zeros and suffixes; None if it is unknown."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower().rstrip("."))
    for form in (name, re.sub(r"\.0$", "", name), re.sub(r"-\d+(\.\d+)*$", "", name)):
        if form in FAMILIES:
            return FAMILIES[form]
    return None


def evaluate(rpn: list[str]) -> tuple[frozenset[str], frozenset[str], bool, int | None]:
    """Labels of the licences named, identifiers unknown, whether there is a choice, and what the expression obliges to (None: unknown)."""
    stack: list[tuple[frozenset[str], frozenset[str], bool, int | None, str]] = []
    none: frozenset[str] = frozenset()
    for token in rpn:
        if token in _RANK and len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                if right[4] and right[4].lower() in EXCEPTIONS:
                    stack.append((*left[:3], _WEAK if left[3] == _STRONG else left[3], ""))
                else:  # what an unknown exception allows is unknown
                    stack.append((left[0], left[1] | right[1] | (frozenset([right[4]]) if right[4] else none), left[2], None, ""))
                continue
            known = [x[3] for x in (left, right) if x[3] is not None]
            if token == "or":
                level = min(known, default=None)
            else:
                level = max(known) if len(known) == 2 else None
            stack.append((left[0] | right[0], left[1] | right[1], left[2] or right[2] or token == "or", level, ""))
        elif found := family(token):
            stack.append((frozenset([found[0]]), none, False, found[1], token))
        else:
            stack.append((none, frozenset([token]), False, None, token))
    return stack[-1][:4]


def phrases() -> dict[str, str]:
    """All notice phrases with their labels: those written out, and those of versions and clauses by rule."""
    out = dict(NOTICES)
    for names, versions in VERSIONED:
        for name in names:
            for v in versions:
                out |= {f"{name} {word}{v}": f"{names[0]}-{v}" for word in ("", "v", "version ")}
        out |= {f"{names[0]}v{v}": f"{names[0]}-{v}" for v in versions}
    for figure, word in CLAUSES:
        label = "bsd" if figure == "0" else f"bsd-{figure}-clause"
        out |= {f"bsd {figure} clause": label, f"{figure} clause bsd": label, f"{word} clause bsd": label}
    return out | BASE


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in phrases().items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    found.add_word(f" {TAG} ", (len(TAG) + 2, None, False))
    found.make_automaton()
    return found


def scan(finder: ahocorasick.Automaton, raw: bytes) -> tuple:
    """One text: words, base places, first and last base word, base labels, all labels, expressions, unknown identifiers, choice, obligation, score."""
    words = raw.translate(TABLE).split()
    text = (b" " + b" ".join(words) + b" ").decode("utf-8")
    n_base, first, last, tagged = 0, None, None, False
    base: set[str] = set()
    hits: list[tuple[int, int, str]] = []
    starts: list[int] = []
    for end, (length, label, is_base) in finder.iter(text):
        if label is None:
            tagged = True
            continue
        hits.append((end - length + 1, end, label))
        if is_base:
            starts = starts or list(accumulate((len(w.decode("utf-8")) + 1 for w in words), initial=1))
            at = bisect(starts, end - length + 2) - 1
            n_base += 1
            first, last = (at if first is None else min(first, at)), (at if last is None else max(last, at))
            base.add(label)
    # of notices within one another the longest stands; base labels stay
    labels, reach = set(base), -1
    for _, end, label in sorted(hits, key=lambda h: (h[0], -h[1])):
        if end > reach:
            labels.add(label)
            reach = end
    expressions, unknown, choice, levels = [], set(), False, []
    if tagged:
        tags = [m.span() for m in _TAG.finditer(raw)]
        line_end = -1
        for i, (_, start) in enumerate(tags):
            if line_end < start:
                line_end = (raw.find(b"\n", start) + 1 or len(raw) + 1) - 1
            # up to the line's end or the next tag, whose colon ends any expression
            upto = min(line_end, tags[i + 1][1]) if i + 1 < len(tags) else line_end
            rpn = postfix(raw[start:upto].decode("utf-8"))
            if rpn:
                names, other, any_of, level = evaluate(rpn)
                expressions.append(" ".join(rpn))
                labels |= names
                unknown |= other
                choice = choice or any_of
                levels.append(level)
    obliges = LEVELS[max(levels)] if levels and None not in levels else None
    score = 1.0 if expressions and not unknown else 0.9 if base else 0.6 if labels else 0.5 if unknown else 0.0
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), expressions, sorted(unknown), choice, obliges, score


_FIELDS = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("expressions", pa.list_(pa.string())), ("unknown", pa.list_(pa.string())), ("choice", pa.bool_()), ("obliges", pa.string()), ("score", pa.float64())])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = automaton()
    names = [f.name for f in _FIELDS]
    for batch in batches:
        for a, b, data, offsets in slices(batch["text"]):
            whole = data.tobytes()
            rows = [scan(finder, whole[x:y]) for x, y in zip(offsets, offsets[1:])]
            columns = [pa.array(x, _FIELDS.field(n).type) for n, x in zip(names, zip(*rows))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), *columns], ["doc_id", *names])


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, words, base places and labels, all labels, expressions and what they say, score.

    Null and empty texts have no words, no labels (empty strings) and score 0. Words are maximal runs of
    ASCII letters and digits and of all characters beyond ASCII. Repeated rows are scanned alike. A
    licence has one label, named by notice or identifier; identifiers of no known family, and exceptions that aren't known, go to
    ``unknown``, not to the labels. ``obliges`` is the strictest of the text's expressions (null with
    none, or if an unknown identifier decides). The score is 1 with expressions of known identifiers, 0.9
    with a base phrase, 0.6 with another notice, 0.5 with unknown identifiers only, else 0. An expression
    that breaks off counts up to its first licence. The work is linear in a text's length and places.
    Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_scanned, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, unknown array<string>, choice boolean, obliges string, score double")
