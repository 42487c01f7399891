r"""Licence scan by patience alignment.

Text and template are word sequences (letters and digits, lower case).  A template is aligned with a
window of the text: words that are unique in both are anchors, the longest increasing subsequence of
the anchors' places is kept, and the gaps before, between and behind them are aligned likewise;
words that begin or end a gap alike are taken first.  Coverage is the share of the template's
words that are aligned.

Words that tell licences apart (TELLING and a template's numbers) decide beside the coverage: all that
a template has must be aligned, and the match holds no word of TELLING that the template lacks.

An occurrence is a stretch of text of at most STRETCH times the template's words (a parameter) whose
alignment reaches the coverage; a notice into which more is inserted isn't one.  Windows start where
enough of the template's words come close together; one without that many can't reach the coverage.
After a match the search goes on behind it, so a licence that a text has twice is found twice.
The alignment can be shorter than the longest common subsequence where no unique word anchors it;
the tests measure how often that costs an occurrence.

Defined results: null, empty or word-free text has no match; matches of a template don't overlap,
those of different templates can, and a match that lies inside a longer match of another template is
left out; of two templates over the same words the better covered one stays, then the one listed
first; the templates are the usual notices, not the licences' full texts; texts are
scanned whole; repeated rows get equal results; a null doc_id is returned as it is; an empty table
gives an empty table; further columns aren't looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame

from .common import map_rows

WORDS = re.compile(r"[^\W_]+")
COVERAGE, STRETCH = 0.8, 1.3
TELLING = frozenset(("nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "noderivs", "affero", "lesser", "library"))

#: Short notices of public licences.
TEMPLATES: dict[str, str] = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MIT (mention)": "Released under the MIT License.",
    "Apache-2.0 (mention)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (mention)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (mention)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (mention)": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0 (mention)": "This work is licensed under the GNU General Public License, version 2.",
    "AGPL-3.0 (mention)": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0 (mention)": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1 (mention)": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "CC-BY-4.0 (short mention)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (short mention)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0 (short mention)": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0 (short mention)": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0 (short mention)": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-4.0 (long mention)": "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0 (long mention)": "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0 (long mention)": "Licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0 (long mention)": "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0 (long mention)": "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}


def words_of(text: str) -> list[str]:
    """The words in lower case; the i-th is that of the i-th match of WORDS in the text."""
    return [w.lower() for w in WORDS.findall(text)]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (by rising first) whose seconds rise."""
    ends: list[int] = []
    tails: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(ends, b)
        before.append(tails[k - 1] if k else -1)
        ends[k : k + 1] = [b]
        tails[k : k + 1] = [i]
    out, i = [], tails[-1] if tails else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (place in the text, place in the template) pairs, both rising."""
    out = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        one, two = Counter(text[a:b]), Counter(template[c:d])
        at = {w: i for i, w in enumerate(template[c:d], c) if two[w] == 1 and one[w] == 1}
        chain = rising([(i, at[w]) for i, w in enumerate(text[a:b], a) if w in at])
        if not chain:
            continue
        out += chain
        edges = [(a - 1, c - 1), *chain, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Template:
    def __init__(self, name: str, notice: str, coverage: float, stretch: float):
        self.name, self.words = name, words_of(notice)
        self.counts = Counter(self.words)
        self.telling = [j for j, w in enumerate(self.words) if w in TELLING or w.isdigit()]
        self.least = max(1, -(-int(coverage * len(self.words) * 1000) // 1000))
        self.width = int(len(self.words) * stretch) + 2

    def can_be_in(self, present: set[str]) -> bool:
        """Whether the words present could cover enough of the template."""
        return sum(n for w, n in self.counts.items() if w in present) >= self.least

    def told(self, text: list[str], start: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether the telling words of the template are aligned, and the match holds no others."""
        aligned = {j for _, j in pairs}
        if any(j not in aligned for j in self.telling):
            return False
        within = Counter(w for w in text[start + pairs[0][0] : start + pairs[-1][0] + 1] if w in TELLING)
        return all(self.counts[w] for w in within)

    def find(self, text: list[str]) -> list[tuple[int, int, int]]:
        """(first word, word behind the last, aligned words) of each occurrence."""
        hits = [i for i, w in enumerate(text) if w in self.counts]
        found, k = [], 0
        while k < len(hits):
            start = hits[k]
            if bisect_right(hits, start + self.width - 1) - k < self.least:
                k += 1
                continue
            pairs = align(text[start : start + self.width], self.words)
            if len(pairs) < self.least:
                k += 1
                continue
            # a later start may drop stray words before the notice
            while (more := bisect_left(hits, start + pairs[0][0] + 1)) < len(hits) and len(better := align(text[hits[more] : hits[more] + self.width], self.words)) > len(pairs):
                start, pairs = hits[more], better
            if not self.told(text, start, pairs):
                k += 1
                continue
            found.append((start + pairs[0][0], start + pairs[-1][0] + 1, len(pairs)))
            k = bisect_left(hits, found[-1][1])
        return found


_BUILT: dict[tuple, list[Template]] = {}


def built(templates: dict[str, str], coverage: float, stretch: float) -> list[Template]:
    key = (tuple(templates.items()), coverage, stretch)
    if key not in _BUILT:
        _BUILT[key] = [Template(n, t, coverage, stretch) for n, t in templates.items()]
    return _BUILT[key]


def outermost(got: list[tuple[int, int, int, int, Template]]) -> list[tuple[int, int, int, int, Template]]:
    """The matches (start, end, aligned, order, template) that lie in no longer one, one for the same words, by place.

    Matches of a template don't overlap, so a sweep that keeps the farthest end so far is enough.
    """
    kept, far = [], -1
    for g in sorted(got, key=lambda g: (g[0], -g[1], -g[2] / len(g[4].words), g[3])):
        if g[1] > far:
            kept.append(g)
            far = g[1]
    return sorted(kept, key=lambda g: (g[0], g[3]))


def scan_text(text: str | None, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, stretch: float = STRETCH) -> list[dict]:
    """The matches: license, covered and template_words (counts), start and end (code points)."""
    if not text:
        return []
    words = words_of(text)
    present = set(words)
    got = []
    for order, t in enumerate(built(templates, coverage, stretch)):
        if t.can_be_in(present):
            got += [(a, b, n, order, t) for a, b, n in t.find(words)]
    if not got:
        return []
    spans = [m.span() for m in WORDS.finditer(text)]
    return [{"license": t.name, "covered": n, "template_words": len(t.words), "start": spans[a][0], "end": spans[b - 1][1]} for a, b, n, _, t in outermost(got)]


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, stretch: float = STRETCH) -> DataFrame:
    """A row per match: doc_id, license, covered, template_words, start, end."""

    def rows(batch: list[dict]) -> list[dict]:
        return [{"doc_id": r[doc_id]} | m for r in batch for m in scan_text(r[text], templates, coverage, stretch)]

    return map_rows(df.select(doc_id, text), rows, 'doc_id bigint, license string, covered bigint, template_words bigint, start bigint, end bigint')
