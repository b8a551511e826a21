"""Licence scan: Dice coefficient over word bigrams between text windows and licence templates.

Text and templates are normalised to lower-case runs of ASCII letters and digits. For each template the
windows of its length are compared (the whole text, if that is shorter). Two bounds prune first: a Dice
coefficient of at least ``t`` needs a text of at least t/(2-t) of the template's bigrams, and as many
bigrams in common as t/2 times both sizes. Of overlapping matches the best stays; one with a sentence that
several licences share gives way to one with the clauses that tell them apart. One pass over the whole
texts, no shuffle; the templates are a fixed list and travel with the code.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import attach

THRESHOLD = 0.8

_GNU = (
    "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by "
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_GNU_KINDS = (
    ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.0", "Library General", "2"), ("LGPL-2.1", "Lesser General", "2.1"),
    ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"),
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"
)

# Customary notices of public licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    *((name, _GNU.format(work, kind, version)) for name, kind, version in _GNU_KINDS for work in ("program", "library")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met:"),
    ("BSD-2-Clause", _BSD + _DISCLAIMER),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission. " + _DISCLAIMER),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def dice(left: Counter, right: Counter) -> float:
    total = left.total() + right.total()
    return 2 * (left & right).total() / total if total else 0.0


@dataclass
class Template:
    name: str
    bigrams: Counter
    size: int
    shared: bool = False  # all of it also stands in the longer notice of another licence


class Scanner:
    """Bigrams of all templates as numbers; templates of fewer than two words cannot match."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float) -> None:
        self.threshold, self.words = threshold, {}
        self.base = 1 + len({w for _, text in templates for w in normal_words(text)})
        self.templates = []
        for name, text in templates:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in normal_words(text)]
            if len(ids) > 1:
                codes = [a * self.base + b for a, b in zip(ids, ids[1:])]
                self.templates.append(Template(name, Counter(codes), len(codes)))
        for t in self.templates:
            t.shared = any(o.name != t.name and o.size > t.size and not t.bigrams - o.bigrams for o in self.templates)
        self.known = np.array(sorted({c for t in self.templates for c in t.bigrams}), np.int64)
        self.holds = np.array([[c in t.bigrams for t in self.templates] for c in self.known.tolist()], bool)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, Dice coefficient, first word, end word), in the order of the text."""
        found = normal_words(text)
        get = self.words.get
        ids = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
        if not len(self.known) or len(ids) < 2:
            return []
        codes = ids[:-1] * self.base + ids[1:]
        near = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        at = np.flatnonzero((self.known[near] == codes) & (ids[:-1] > 0) & (ids[1:] > 0))
        matches = []
        for number, template in enumerate(self.templates):
            size = min(template.size, len(codes))
            need = self.threshold / 2 * (size + template.size)
            if size < self.threshold / (2 - self.threshold) * template.size:
                continue
            mine = at[self.holds[near[at], number]]
            if len(mine) < need:
                continue
            # Windows that start at a hit, or end with the text: others hold no more hits than these.
            starts = np.unique(np.minimum(mine, len(codes) - size))
            inside = np.searchsorted(mine, starts + size) - np.searchsorted(mine, starts)
            for start in starts[inside >= need].tolist():
                value = dice(Counter(codes[start : start + size].tolist()), template.bigrams)
                if value >= self.threshold:
                    matches.append((template.shared, -value, -template.size, start, start + size + 1, template.name))
        kept: list[tuple[str, float, int, int]] = []
        taken = np.zeros(len(ids), bool)
        for _, value, _, start, end, name in sorted(matches):
            if not taken[start:end].any():
                taken[start:end] = True
                kept.append((name, -value, start, end))
        return sorted(kept, key=lambda m: m[2])


def scan(documents: DataFrame, name: str, text: str = "text", keep: list[str] | None = None,
         templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` and a struct ``name`` with the array ``matches``: licence, dice, first, end (in words)."""
    scanner = Scanner(templates, threshold)

    def kernel(texts: pa.Array) -> dict[str, list]:
        rows = [scanner.scan(t) for t in texts.to_pylist()]
        return {"matches": [[dict(zip(("licence", "dice", "first", "end"), m)) for m in row] for row in rows]}

    return attach(documents, [text], kernel, "matches array<struct<licence string, dice double, first int, end int>>", name, keep=keep)


def report(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_matches, licences (distinct, sorted, comma-joined), best_dice.

    Texts without words, NULL ones included, have no match and a NULL best_dice.
    """
    found = scan(documents, "found", keep=["doc_id"])
    names = F.array_sort(F.array_distinct(F.transform("found.matches", lambda m: m["licence"])))
    return found.select(
        "doc_id", F.size("found.matches").cast("bigint").alias("n_matches"), F.array_join(names, ",").alias("licences"),
        F.round(F.array_max(F.transform("found.matches", lambda m: m["dice"])), 9).alias("best_dice"),
    )
