"""License scans by conditional compression, confirmed by exact wording.

A trigger word starts a candidate; every template must hold one, so that a text is missed only if all its trigger words are altered.
For each trigger word of each template, the block of text that the template would cover around the trigger is compressed twice with
zstandard, once plainly and once with the template as raw dictionary. Every block that this makes
smaller is aligned with the template word by word. Of those that hold the trigger and whose wording differs in
no more than a tenth of the template's words, the longest with the fewest differences is the
match; the differences are part of the result.

Nulls and edges: null and empty texts have no match; a text may have many matches, which don't
overlap; whole texts are searched, however long; rows repeat as often as the input has them;
other columns play no part.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import text as tx

TRIGGER = r"licen[sc]|permission|redistribut|public domain|copyleft"
#: Notices and short licence texts as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT notice": "Licensed under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide.",
}
_WORD = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+(?:[\-'][^\W_]+)*")


class Template:
    def __init__(self, name: str, text: str, trigger: re.Pattern):
        self.name, self.words = name, [w.lower() for w in _WORD.findall(text)]
        at = [m.start() for m in trigger.finditer(text)]
        if not at:
            raise ValueError(f"the template {name} holds no trigger word")
        starts = [m.start() for m in _WORD.finditer(text)]
        where = [bisect.bisect_right(starts, a) - 1 for a in at]
        self.where, self.counts = sorted(set(where)), Counter(self.words)
        self.slack = len(self.words) // 10
        raw = zstandard.ZstdCompressionDict(" ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zip = zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)


class Scanner:
    def __init__(self, templates: dict[str, str], trigger: str = TRIGGER):
        self.trigger = re.compile(trigger, re.I)
        self.templates = [Template(n, t, self.trigger) for n, t in sorted(templates.items())]
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)

    def scan(self, text: str) -> list[tuple[str, int, int, float, int, list[str]]]:
        """(license, first character, end, share of size taken away, words that differ, differences) of each match."""
        triggers = [m.start() for m in self.trigger.finditer(text)]
        if not triggers:
            return []
        places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        starts = [a for a, _ in places]
        out, done = [], 0
        for t in triggers:
            k = bisect.bisect_right(starts, t) - 1
            if k < done:
                continue
            good = []
            for tp in self.templates:
                n = len(tp.words)
                for a, b in sorted({(max(done, k - w - tp.slack), min(len(places), k + n - w + tp.slack)) for w in tp.where}):
                    words = [text[x:y].lower() for x, y in places[a:b]]
                    if (tp.counts & Counter(words)).total() < n - tp.slack:  # each word that is not there is an edit
                        continue
                    block = " ".join(words).encode()
                    size = len(self.plain.compress(block))
                    share = (size - len(tp.zip.compress(block))) / size
                    if share > 0 and (g := self.confirm(tp, a, words, share)) and g[1] <= k < g[2]:
                        good.append(g)
            if good:  # of confirmed templates, the longest wording with the fewest differences
                name, a, b, share, edits, differences, _ = max(good, key=lambda g: (g[6] - 2 * g[4], g[3]))
                out.append((name, places[a][0], places[b - 1][1], share, edits, differences))
                done = b
        return out

    @staticmethod
    def confirm(tp: Template, a: int, words: list[str], share: float):
        """The aligned span, or None if more than a tenth of the template's words differ."""
        blocks = [m for m in difflib.SequenceMatcher(None, tp.words, words, autojunk=False).get_matching_blocks() if m.size]
        if not blocks:
            return None
        spots = [(0, blocks[0].a, blocks[0].b, blocks[0].b)] + [(x.a + x.size, y.a, x.b + x.size, y.b) for x, y in zip(blocks, blocks[1:])] + [(blocks[-1].a + blocks[-1].size, len(tp.words), 0, 0)]
        differences, edits = [], 0
        for i, j, x, y in spots:
            if i < j or x < y:
                edits += max(j - i, y - x)
                differences.append(f"{' '.join(tp.words[i:j])} -> {' '.join(words[x:y])}")
        if edits > tp.slack:
            return None
        return tp.name, a + blocks[0].b, a + blocks[-1].b + blocks[-1].size, share, edits, differences, len(tp.words)


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...], trigger: str) -> Scanner:
    return Scanner(dict(templates), trigger)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, trigger: str = TRIGGER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, match, license, first_char, end_char, reduction, edits, differences), one row per match."""
    given = tuple(sorted(templates.items()))
    names = ["match", "license", "first_char", "end_char", "reduction", "edits", "differences"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.string())]

    def run(batches):
        s = _scanner(given, trigger)
        for b in tx.slices(batches, "t"):
            b = b.filter(pc.fill_null(pc.match_substring_regex(b.column("t"), trigger, ignore_case=True), False))
            rows = [(k, n, *m) for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist()) for n, m in enumerate(s.scan(t))]
            cols = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("k").type), *(pa.array(c, t) for c, t in zip(cols[1:], kinds))], [key, *names])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    return rows.mapInArrow(run, f"{key} {rows.schema['k'].dataType.simpleString()}, match int, license string, first_char long, end_char long, reduction double, edits int, differences array<string>")
