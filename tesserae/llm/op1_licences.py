"""License scans: normalised text compared with licence templates by Dice coefficient over word bigrams.

All runs of a text's words are compared, across lines and paragraphs, so a notice is found wherever it starts and
ends. A run's best form starts and ends with a bigram of the template and doesn't hold its first one again; it
reaches the threshold t only with (2 - t) / t * b distinct bigrams at most, where the template has b, and only if
the whole text has t / (2 - t) * b of these, which few texts have.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import as_bytes

#: Licence notices and short licence texts, by identifier. Several templates may share one.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

THRESHOLD = 80
#: A-Z become small letters; all that is no ASCII letter or digit and below 0x80 parts words.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def bigrams(words: list[bytes]) -> set:
    return set(zip(words, words[1:], strict=False))


class Matcher:
    def __init__(self, templates=TEMPLATES, percent: int = THRESHOLD):
        self.percent = percent
        self.made = [(name, g) for name, g in ((n, bigrams(t.encode().translate(_TABLE).split())) for n, t in templates) if g]
        self.owners: dict[tuple, list[int]] = defaultdict(list)
        for n, (_, grams) in enumerate(self.made):
            for g in grams:
                self.owners[g].append(n)

    def best_run(self, own: list[tuple], grams: set) -> tuple[int, int]:
        """(2 * common, sum of sizes) of the run of bigrams that is most like a template's; (0, 1) below the threshold."""
        best, size = (0, 1), len(grams)
        for start in (i for i, g in enumerate(own) if g in grams):
            seen, common = set(), 0
            for i in range(start, len(own)):
                g = own[i]
                if g in seen:
                    if g == own[start]:  # the run from the next bigram on holds the same
                        break
                    continue
                seen.add(g)
                if self.percent * len(seen) > (200 - self.percent) * size:
                    break
                if g in grams:
                    common += 1
                    twice, total = 2 * common, size + len(seen)
                    if 100 * twice >= self.percent * total and twice * best[1] > best[0] * total:
                        best = twice, total
        return best

    def scan(self, text: bytes | None) -> dict[str, float]:
        """The best coefficient of each licence found."""
        words = text.translate(_TABLE).split() if text else []
        hits = Counter(n for g in self.owners.keys() & bigrams(words) for n in self.owners[g])
        best: dict[str, float] = {}
        own = None
        for n, common in hits.items():
            name, grams = self.made[n]
            if (200 - self.percent) * common < self.percent * len(grams):
                continue
            own = own or list(zip(words, words[1:], strict=False))
            twice, total = self.best_run(own, grams)
            if twice:
                best[name] = max(best.get(name, 0.0), twice / total)
        return best


def scan_licences(docs: DataFrame, templates=TEMPLATES, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, licence, dice, licences for each row of docs.

    licence is the best one (ties: first by name) and dice its coefficient, rounded to six places; licences is
    all found, sorted and joined by commas. Null, empty and other texts without a licence have null, 0 and "".
    """

    def run(batches):
        matcher = Matcher(templates, percent)
        for batch in batches:
            found = [matcher.scan(t) for t in as_bytes(batch.column("text"))]
            best = [min(f, key=lambda n: (-f[n], n)) if f else None for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(best, pa.string()), pa.array([round(f[b], 6) if b else 0.0 for f, b in zip(found, best, strict=True)], pa.float64()), pa.array([",".join(sorted(f)) for f in found], pa.string())],
                ["doc_id", "licence", "dice", "licences"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, licence string, dice double, licences string")
