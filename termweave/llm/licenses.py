"""License scans: an Aho-Corasick automaton finds tags and notices, a shunting-yard parser evaluates expressions.

Texts are lower-cased (A-Z) and their words put in a row between single spaces, so that an automaton match of
` phrase ` is a place where the phrase's words stand consecutively. Behind an identifier tag the rest of the
line is read as a licence expression with and, or, with and parentheses. The score says how much the terms
found restrict reuse: 0 without any label, 1 for all rights reserved; `or` takes the freest side, `and` the
strictest, and separate notices add up like `and`.

Defined cases: null and empty texts have no word and no label; repeats and null doc_ids come back row by row;
an expression that can't be parsed gives its known identifiers as if joined by and; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from termweave.llm.common import raw, slices, small_batches, table

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "apache license": "apache", "mit license": "mit", "bsd license": "bsd", "isc license": "isc", "mozilla public license": "mpl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "eclipse public license": "epl",
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0", "cc zero": "cc0", "public domain": "public-domain",
    "creative commons attribution": "cc-by", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution sharealike": "cc-by-sa",
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd", "unlicense": "unlicense",
    "no part of this publication may be reproduced": "reserved", "confidential and proprietary": "proprietary",
}
TAG = "spdx license identifier"
#: How much a label restricts reuse.
STRICT = {"cc0": 0.05, "public-domain": 0.05, "unlicense": 0.05, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "apache": 0.15, "cc-by": 0.2, "mpl": 0.35, "lgpl": 0.35, "epl": 0.4, "cc-by-sa": 0.4, "gpl": 0.5, "agpl": 0.6, "cc-by-nc": 0.7, "cc-by-nd": 0.8, "proprietary": 1.0, "reserved": 1.0}
_IDS = [("cc0", "cc0"), ("cc-by-nc", "cc-by-nc"), ("cc-by-nd", "cc-by-nd"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"), ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"), ("0bsd", "bsd"), ("isc", "isc"), ("mpl", "mpl"), ("epl", "epl"), ("unlicense", "unlicense")]
_MARK = re.compile(r"spdx-license-identifier\s*:?[ \t]*", re.I)
_PART = re.compile(r"[^\S\r\n]*([()]|[^\s()]+)")

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_TO_SPACE = bytes(i + 32 if 65 <= i < 91 else i if _WORD[i] else 32 for i in range(256))


def label_of(identifier: str) -> str | None:
    """The label of a licence identifier such as GPL-3.0-or-later."""
    return next((label for start, label in _IDS if identifier.lower().startswith(start)), None)


def _parts(text: str, at: int) -> Iterator[str]:
    """Operands, operators and parentheses from a place to the end of its line, as they are asked for."""
    while m := _PART.match(text, at):
        yield m[1]
        at = m.end()


def evaluate(text: str, at: int = 0) -> tuple[set[str], float]:
    """Labels in the licence expression there and how strict it is; `with` binds first, then and, then or.

    >>> evaluate("MIT OR (GPL-2.0 WITH Classpath-exception-2.0 AND BSD-3-Clause)")[1]
    0.1
    """
    rank, out, ops, labels = {"or": 1, "and": 2, "with": 3}, [], [], set()

    def apply() -> None:
        op, b, a = ops.pop(), out.pop(), out.pop()
        out.append(min(a, b) if op == "or" else max(a, b) if op == "and" else a * 0.9)

    wanted = True  # an operand is
    try:
        for part in _parts(text, at):
            low = part.lower()
            if low in rank:
                if wanted:
                    raise IndexError
                while ops and ops[-1] != "(" and rank[ops[-1]] >= rank[low]:
                    apply()
                ops.append(low)
                wanted = True
            elif part == "(":
                ops.append(part)
            elif part == ")":
                while ops[-1] != "(":
                    apply()
                ops.pop()
            elif not wanted:
                break  # words after the expression
            else:
                label = None if ops and ops[-1] == "with" else label_of(part)
                if label:
                    labels.add(label)
                out.append(STRICT[label] if label else 0.5)
                wanted = False
        while ops:
            apply()
        return (labels, out[0]) if labels else (set(), 0.0)
    except IndexError:
        return labels, max((STRICT[x] for x in labels), default=0.0)


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: ""}.items():
        a.add_word(f" {phrase} ", (phrase, label))
    a.make_automaton()
    return a


def scan(text: str, a: ahocorasick.Automaton) -> tuple[int, int | None, int | None, set[str], set[str], float]:
    """Places, first and last word of base phrases, base labels, all labels, strictness."""
    row = f" {' '.join(text.encode('utf-8', 'surrogatepass').translate(_TO_SPACE).decode('utf-8', 'surrogatepass').split(' '))} "
    row = re.sub(" +", " ", row)
    n, first, last, base, labels, strict, tagged = 0, None, None, set(), set(), 0.0, False
    words, upto = 0, 0  # blanks before `upto`; ends come in ascending order, so that each blank is counted once
    for end, (phrase, label) in a.iter(row):
        if not label:
            tagged = True
            continue
        labels.add(label)
        strict = max(strict, STRICT[label] if phrase not in BASE else 0.0)
        if phrase in BASE:
            words, upto = words + row.count(" ", upto, end + 1), end + 1
            at = words - phrase.count(" ") - 2
            n, first, last = n + 1, at if first is None else min(first, at), at if last is None else max(last, at)
            base.add(label)
    if tagged:
        for m in _MARK.finditer(text):
            more, s = evaluate(text, m.end())
            labels |= more
            strict = max(strict, s)
    if base:  # "cc by" is also the beginning of stricter terms, which count above
        strict = max([strict, *(STRICT[x] for x in base)])
    return n, first, last, base, labels, strict


#: Each phrase has one of these words; RE2 tells quickly which texts have none.
_SEED = "(?i)(?:" + "|".join(sorted({max(p.split(), key=len) if p != "cc by" else "cc" for p in [*BASE, *NOTICES, TAG]})) + ")"


def licenses(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in slices(batches, "text"):
            buf, off = raw(b.column("text"))
            inside = _WORD[buf]
            begins = inside.copy()
            if len(buf):
                before = np.zeros(len(buf), bool)
                before[1:] = inside[:-1]
                before[off[:-1][off[:-1] < len(buf)]] = False
                begins &= ~before
            total = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(begins, out=total[1:])
            hit = pc.fill_null(pc.match_substring_regex(b.column("text"), _SEED), False).to_numpy(zero_copy_only=False)
            got = [scan(b.column("text")[i].as_py(), a) if h else (0, None, None, (), (), 0.0) for i, h in enumerate(hit)]
            n, first, last, base, labels, strict = zip(*got, strict=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id"),
                    "n_words": total[off[1:]] - total[off[:-1]],
                    "n_base": pa.array(n, pa.int64()),
                    "first_word": pa.array(first, pa.int64()),
                    "last_word": pa.array(last, pa.int64()),
                    "base_labels": [",".join(sorted(x)) for x in base],
                    "labels": [",".join(sorted(x)) for x in labels],
                    "score": pa.array(strict, pa.float64()),
                }
            )

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
