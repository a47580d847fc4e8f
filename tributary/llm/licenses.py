"""License scans by conditional compression, confirmed by exact differences in wording."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.runtime import map_batches

# Identifiers, names and wordings of public licenses and notices.
NAMES = {
    "MIT": ("MIT License",),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "BSD": ("BSD License",),
    "Apache-1.1": ("Apache License, Version 1.1",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPL version 2"),
    "GPL-2.0-or-later": ("GNU General Public License, version 2 or later",),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL version 3"),
    "GPL-3.0-or-later": ("GNU General Public License, version 3 or later",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, version 2.0",),
    "EPL-2.0": ("Eclipse Public License, version 2.0",),
    "BSL-1.0": ("Boost Software License, version 1.0",),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "Unlicense": ("The Unlicense",),
}
CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = ("2.0", "3.0", "4.0")
TEXTS = {
    "Apache-2.0": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "GPL-2.0-or-later": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "GPL-3.0-or-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "LGPL-2.1-or-later": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "AGPL-3.0-or-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "all-rights-reserved": ("All rights reserved.",),
}
#: Words that a notice may have or lack without being another one.
FILLERS = frozenset("the a an this that is are be and of in by under to for with its work works file files code source software project package program text document material content licensed licenced released distributed published available provided license licence licenses terms conditions international version v. v".split())
#: Words that make it another license wherever they differ, as does any word with a digit.
NAMING = frozenset("mit bsd isc apache gnu gpl lgpl agpl lesser library affero mozilla mpl eclipse boost creative commons attribution noncommercial non-commercial noderivatives noderivs sharealike by nc nd sa by-nc by-sa by-nd not no without except only later new simplified clause neither nor".split())
#: What turns a notice round if it stands right before it, or makes another license of it right behind it.
BEFORE, BEHIND = frozenset("not no never isn't non".split()), ("or later", "or any later", "or at your option any later", "only")
SIGNAL = r"licen[cs]e|copyright|rights\s+reserved|public\s+domain|creative\s+commons|\bCC[ -](?:BY|0)|redistribut|permission\s+(?:is\s+hereby|to\s+use)|warrant(?:y|ies)|\bGPL\b|without\s+specific\s+prior"
#: A block's size must fall by this part at least when the template is known. Templates of LONG words and more may differ in
#: so many of their words at most, if none of them is a naming one; shorter ones only in fillers.
REDUCTION, LONG, DIFFERING = 0.3, 14, 0.1
LEVEL = 9
#: Lines between two signals, and before and behind them, that belong to one hard-wrapped notice; and characters of a block.
NEAR_LINES, BLOCK_CHARS = 4, 6_000

_SIGNAL = re.compile(SIGNAL, re.I)
_SENTENCE = re.compile(r"[^\n]+?(?:(?<!\bv)[.!?](?=\s)|(?=\n)|$)", re.M)
_LINE = re.compile(r"[^\n]+")
_WORD = re.compile(r"[\w.+/'-]*\w")


def templates_of() -> dict[str, tuple[str, str]]:
    """(license, wording) of each form: texts, sentences with each name, and SPDX lines, by rule from the fixed values."""
    names = dict(NAMES)
    for kind, said in CC_KINDS.items():
        for v in CC_VERSIONS:
            names[f"CC-{kind}-{v}"] = (f"CC {kind} {v}", f"Creative Commons {said} {v}")
    out = {}
    for own, forms in names.items():
        for i, name in enumerate(forms):
            out[f"{own}:name{i}"] = (own, f"Licensed under the {name}.")
        out[f"{own}:spdx"] = (own, f"SPDX-License-Identifier: {own}")
    for own, texts in TEXTS.items():
        for i, text in enumerate(texts):
            out[f"{own}:text{i}"] = (own, text)
    return out


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of sentences with a license's words, joined where only white space is between two."""
    out: list[tuple[int, int]] = []
    for m in _SENTENCE.finditer(text):
        a, b = m.span()
        while a < b and text[a].isspace():
            a += 1
        if a < b and _SIGNAL.search(text, a, b):
            if out and not text[out[-1][1] : a].strip():
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def wrapped(text: str) -> list[tuple[int, int]]:
    """Spans of lines around signals that notices of several sentences or lines may lie in: no blank line is inside one. Long spans
    are cut into pieces that overlap by half, so that each notice lies whole in one."""
    lines = [m.span() for m in _LINE.finditer(text)]
    solid = [bool(text[a:b].strip()) for a, b in lines]
    touches = [i > 0 and lines[i][0] == lines[i - 1][1] + 1 and solid[i] and solid[i - 1] for i in range(len(lines))]
    out: list[list[int]] = []
    for i, (a, b) in enumerate(lines):
        if not _SIGNAL.search(text, a, b):
            continue
        first = last = i
        while first > 0 and i - first < NEAR_LINES and touches[first]:
            first -= 1
        while last + 1 < len(lines) and last - i < NEAR_LINES and touches[last + 1]:
            last += 1
        if out and first <= out[-1][1]:
            out[-1][1] = max(last, out[-1][1])
        else:
            out.append([first, last])
    spans = []
    for first, last in out:
        a, end = lines[first][0], lines[last][1]
        while end - a > BLOCK_CHARS:
            spans.append((a, a + BLOCK_CHARS))
            a += BLOCK_CHARS // 2
        spans.append((a, end))
    return spans


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def differences(block: list[str], template: list[str]) -> tuple[int, int, int, list[str]]:
    """Where the template's wording lies in the block (words from, to), how many of its words are there in order, and the wording
    between that differs: -left out, +put in."""
    codes = [c for c in SequenceMatcher(None, template, block, autojunk=False).get_opcodes()]
    equal = [c for c in codes if c[0] == "equal"]
    if not equal:
        return 0, 0, 0, [f"-{w}" for w in template]
    first, last = equal[0][3], equal[-1][4]
    said: list[str] = []
    for kind, i, j, k, m in codes:
        if kind != "equal":
            said += [f"-{w}" for w in template[i:j]] + [f"+{w}" for w in block[max(k, first) : min(m, last)]]
    return first, last, sum(c[2] - c[1] for c in equal), said


def confirmed(template: list[str], said: list[str]) -> bool:
    """Whether differences leave a template's license the same."""
    words = [w[1:] for w in said]
    if len(template) < LONG:
        return all(w in FILLERS for w in words) and any(w not in FILLERS for w in template)
    return len(words) <= DIFFERING * len(template) and not any(w in NAMING or any(c.isdigit() for c in w) for w in words)


class Scanner:
    """Sizes of a block with and without each template as zstandard's raw dictionary."""

    def __init__(self, templates: dict[str, tuple[str, str]]):
        import zstandard

        self.templates = templates
        self.words = {k: [w for w, _, _ in _words(t)] for k, (_, t) in templates.items()}
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = {k: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, (_, t) in templates.items()}
        self._done: dict[str, tuple | None] = {}

    def reductions(self, block: str) -> list[tuple[float, str]]:
        """Every template's relative reduction of the block's size, the largest first; among equals by name."""
        data = " ".join(block.split()).encode()
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(c.compress(data)) / alone, k) for k, c in self.given.items()), key=lambda x: (-x[0], x[1]))

    def find(self, block: str) -> tuple[int, int, str, str, float, float, str] | None:
        """(start, end, license, form, reduction, covered, differences) of the best template that the wording confirms, if there is one."""
        if block not in self._done:
            if len(self._done) > 50_000:
                self._done.clear()
            self._done[block] = self._find(block)
        return self._done[block]

    def _find(self, block: str) -> tuple | None:
        own = _words(block)
        words = [w for w, _, _ in own]
        for gain, form in self.reductions(block):
            if gain < REDUCTION:
                return None
            template = self.words[form]
            first, last, same, said = differences(words, template)
            if not same or not confirmed(template, said) or BEFORE.intersection(words[max(0, first - 3) : first]):
                continue
            behind = " ".join(words[last : last + 6])
            if any(behind == x or behind.startswith(f"{x} ") for x in BEHIND):
                continue
            return own[first][1], own[last - 1][2], self.templates[form][0], form.split(":")[1], round(gain, 6), round(same / len(template), 6), " ".join(said)
        return None

    def scan(self, text: str) -> list[tuple]:
        """All findings of a text, none inside another: hard-wrapped notices first, then sentences outside them."""
        out: list[tuple] = []
        for a, b in [*wrapped(text), *blocks(text)]:
            at = a
            while at < b and (found := self.find(text[at:b])):
                x, y, *rest = found
                if not any(at + x < q and p < at + y for p, q, *_ in out):
                    out.append((at + x, at + y, *rest, text[at + x : at + y]))
                at += y
        return sorted(out)


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, end, license, form, reduction, covered, differences, block): one row for each notice that is a template's.

    start and end count characters of the whole text. A template wins by the size that it saves, and stands only if the wording
    differs in nothing that makes another license; else the next is tried. Texts that are null, empty or without a license's words have no
    rows; repeated rows are found each; null keys stay null. Equal reductions are tried by name. Texts without such words don't leave the JVM. No shuffle.
    """
    given = templates or templates_of()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(given)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string())
        for batch in batches:
            rows = [(k, *x) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in own.scan(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], ["k", "start", "end", "license", "form", "reduction", "covered", "differences", "block"])

    source = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).where(F.col("t").rlike(f"(?i){SIGNAL}"))
    return map_batches(source, scanned, "k long, start int, end int, license string, form string, reduction double, covered double, differences string, block string").withColumnRenamed("k", key)
