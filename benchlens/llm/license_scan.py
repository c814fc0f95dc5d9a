"""License scans by conditional compression.

Candidate blocks are runs of sentences made of license wording around a telling word, or that hold one
amid other words.  Each block is
compressed alone and with every template as a zstandard raw dictionary; templates rank by the share
of bytes that they save.  All that a block has words enough for are then compared with it word by
word, best savers first, and the wording differences decide which license, if any, the block states.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and public notices of common licenses, by SPDX identifier.
NAMES = {
    "MIT": ("the MIT License", "MIT License", "the MIT license (MIT)"),
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0", "the Apache 2.0 License"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License"),
    "ISC": ("the ISC License",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU GPL v2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU GPL v3"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "Unlicense": ("the Unlicense",),
}
PHRASES = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This software is licensed under {}.", "Available under the terms of {}.")
NOTICES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: A block is looked at only around one of these.
TELLING = r"(?i)licen[sc]|copyright|permission|redistribut|warrant|public domain|creative commons|\bCC[ -]?(?:BY|0)|\bGPL|free software"
#: Least share of a template's words that a block has in order, and most words besides, by template word.
LEAST_SAME, MOST_EXTRA = 0.85, 0.5
#: Words of names that tell no license from another, and words that make one license another.
PLAIN = frozenset("the a license version international".split())
MODIFYING = frozenset("affero lesser library nc nd sa noncommercial noderivatives noderivs sharealike".split())

_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_SENTENCE = re.compile(r"[^\n.!?;]*(?:[.!?;](?!\s|\Z)[^\n.!?;]*)*[.!?;]?")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@lru_cache(maxsize=4)
def templates(extra: tuple[tuple[str, str], ...] = ()) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(license, words) of all phrases and notices, and of ``extra`` (license, text) pairs."""
    plain = [(k, p.format(n)) for k, names in NAMES.items() for n in names for p in PHRASES]
    return tuple(dict.fromkeys((k, tuple(words_of(t))) for k, t in [*plain, *NOTICES.items(), *extra]))


@lru_cache(maxsize=4)
def _compressors(extra: tuple[tuple[str, str], ...]) -> tuple:
    own = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    with_each = [zstandard.ZstdCompressor(compression_params=own, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, w in templates(extra)]
    return zstandard.ZstdCompressor(compression_params=own), with_each


@lru_cache(maxsize=4)
def _counts(extra: tuple[tuple[str, str], ...]) -> tuple[Counter, ...]:
    return tuple(Counter(w) for _, w in templates(extra))


@lru_cache(maxsize=4)
def _names(extra: tuple[tuple[str, str], ...]) -> tuple[frozenset[str], ...]:
    """For each template, the name and version words that a block must share with it."""
    own = {k: frozenset(w for n in names for w in words_of(n)) - PLAIN for k, names in NAMES.items()}
    added = {(k, tuple(words_of(t))) for k, t in extra}
    return tuple(frozenset() if (k, w) in added else own[k].intersection(w) for k, w in templates(extra))


@lru_cache(maxsize=4)
def _vocabulary(extra: tuple[tuple[str, str], ...]) -> frozenset[str]:
    return frozenset(w for _, t in templates(extra) for w in t)


@lru_cache(maxsize=4)
def _silent(extra: tuple[tuple[str, str], ...]) -> tuple[tuple[Counter, int], ...]:
    """Word counts and lengths of the own templates that have no telling word."""
    told = re.compile(TELLING)
    return tuple((Counter(w), len(w)) for _, t in extra if not told.search(t) and (w := words_of(t)))


def _tells(spoken: str, telling: re.Pattern, extra: tuple[tuple[str, str], ...]) -> bool:
    """Whether a text has a telling word, or words enough for an own template without one."""
    if telling.search(spoken):
        return True
    silent = _silent(extra)
    have = Counter(words_of(spoken)) if silent else Counter()
    return any(sum(min(n, have[w]) for w, n in c.items()) >= LEAST_SAME * size for c, size in silent)


def blocks(text: str, extra: tuple[tuple[str, str], ...] = ()) -> Iterator[tuple[int, int]]:
    """Character ranges of candidate blocks: runs of sentences that mostly use template words, one of them
    telling, or that are telling themselves, with the lines over which such a sentence is wrapped."""
    known, telling = _vocabulary(extra), re.compile(TELLING)
    lines: list[tuple[int, int, bool]] = []  # place, and whether it takes part by its own words
    wrapped: list[bool] = []  # whether a sentence goes on from the line before

    def whole() -> Iterator[tuple[int, int]]:
        if lines and _tells(text[lines[0][0] : lines[-1][1]], telling, extra):
            yield lines[0][0], lines[-1][1]

    for m in _SENTENCE.finditer(text):
        own = words_of(m[0])
        if not own:
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        took = sum(w in known for w in own) >= 0.7 * len(own) or _tells(m[0], telling, extra)
        wrapped.append(bool(lines) and text[lines[-1][1] - 1] not in ".!?;" and text.count("\n", lines[-1][1], start) == 1)
        lines.append((start, m.end(), took))
    every, lines = lines, []
    for i, (start, end, took) in enumerate(every):
        before = wrapped[i] and telling.search(text, every[i - 1][0], every[i - 1][1])
        after = i + 1 < len(every) and wrapped[i + 1] and telling.search(text, every[i + 1][0], every[i + 1][1])
        if took or before or after:
            lines.append((start, end, took))
        else:
            yield from whole()
            lines = []
    yield from whole()


def differences(block: list[str], template: tuple[str, ...]) -> tuple[int, list[str], list[str]]:
    """Words in common (in order), template words that are missing, and block words besides."""
    match = SequenceMatcher(None, template, block, autojunk=False)
    missing, more = [], []
    for kind, a, b, c, d in match.get_opcodes():
        if kind != "equal":
            missing += template[a:b]
            more += block[c:d]
    return len(template) - len(missing), missing, more


def match(block: str, extra: tuple[tuple[str, str], ...] = ()) -> list[dict]:
    """What a block states: licenses with their saving and wording differences, in reading order.

    A license is stated only by a template whose name and version words are among the equal ones, and with no
    word besides that makes it another license.
    Every template that the block has words enough for is compared, down the whole ranking; the one
    that leaves the fewest differences wins, then the longest, then the best saver, then the first
    by name.  What the block has after (or before) the winner's words is looked at again, since
    notices may follow each other.
    """
    spoken = words_of(block)
    plain, with_each = _compressors(extra)
    known = templates(extra)
    out: list[dict] = []
    parts = [spoken]
    while parts:
        part = parts.pop(0)
        if len(part) < 2:
            continue
        have = Counter(part)
        able = {k for k, c in enumerate(_counts(extra)) if sum(min(n, have[w]) for w, n in c.items()) >= LEAST_SAME * len(known[k][1])}
        if not able:  # the others lack too many words to be confirmed
            continue
        raw = " ".join(part).encode()
        alone = len(plain.compress(raw))
        saving = [1 - len(c.compress(raw)) / alone for c in with_each]
        order = sorted(range(len(known)), key=lambda k: (-saving[k], known[k][0], len(known[k][1])))
        best = None
        for k in order:
            if k not in able:
                continue
            same, missing, more = differences(part, known[k][1])
            if same < LEAST_SAME * len(known[k][1]):
                continue
            at = _place(part, known[k][1])
            inner = part[at[0] : at[1]]
            same, missing, more = differences(inner, known[k][1])
            if same < LEAST_SAME * len(known[k][1]) or len(more) > MOST_EXTRA * len(known[k][1]):
                continue
            named = _names(extra)[k]
            if named and (named - (Counter(known[k][1]) - Counter(missing)).keys() or MODIFYING.intersection(more)):
                continue
            key = (len(missing) + len(more), -len(known[k][1]), -saving[k], known[k][0])
            if best is None or key < best[0]:
                best = (key, k, at, missing, more)
        if best is None:
            continue
        _, k, (a, b), missing, more = best
        out.append({"license": known[k][0], "saving": saving[k], "n_words": len(known[k][1]), "missing": missing, "extra": more})
        parts += [part[:a], part[b:]]
    return out


def _place(block: list[str], template: tuple[str, ...]) -> tuple[int, int]:
    """The range of the block that the template's words cover."""
    found = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    return found[0].b, found[-1].b + found[-1].size


_KIND = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("statement", T.IntegerType()),
        T.StructField("first_char", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("license", T.StringType()),
        T.StructField("saving", T.DoubleType()),
        T.StructField("exact", T.BooleanType()),
        T.StructField("missing", T.ArrayType(T.StringType())),
        T.StructField("extra", T.ArrayType(T.StringType())),
    ]
)


def scan(docs: DataFrame, extra: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """One row for each license statement of each document: doc_id, then place, license and differences.

    ``extra`` adds (license, text) templates, with or without a telling word.  Documents without a
    statement (null and empty texts too) give no row, and an empty table none; repeated rows give rows
    each; null ids stay null; very long texts are scanned whole, block by block; templates of equal
    saving are ranked by license and length.  Other columns, whatever their names, are not read.
    Without ``extra``, texts without any telling word never leave the JVM.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    bare = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(TELLING) if not extra else F.col("text").isNotNull())
    schema = T.StructType([bare.schema["doc_id"], *_KIND.fields])
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                for n, (a, b) in enumerate(blocks(text, extra)):
                    for s, found in enumerate(match(text[a:b], extra)):
                        out.append((doc, n, s, a, b - a, found["license"], found["saving"], not (found["missing"] or found["extra"]), found["missing"], found["extra"]))
            columns = zip(*out, strict=True) if out else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return bare.mapInArrow(rows, schema)
