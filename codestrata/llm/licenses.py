"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

1. Document frequencies of the templates' terms are counted over all files, and how many licences have them. A term that no
   template has weighs as one seen in a single file, so words around a licence text lower its cosine.
2. Units of a file are its lines, the whole file, and within each run of neighbouring lines that each resemble a licence
   text (blank lines do not end it) every sequence of its paragraphs. The share of a unit's norm that lies in the templates' terms bounds its cosine
   with any of them; units whose bound is below the threshold are passed over. A template matches from a cosine of THRESHOLD on,
   one of more than SHORT distinct terms from LONG_THRESHOLD on, as long legal texts resemble each other. Of the matches in a file that with the
   most evidence, its cosine times the root of the template's distinct terms, names the licence: a whole text outweighs the
   words "All rights reserved" above it.
3. A file without one takes the licence of the licence file (LICENSE, COPYING, NOTICE ...) in the nearest directory above
   it: directories, not files, are expanded into their ancestors and joined by path.

Defined cases: null and empty texts have no licence of their own; a null path has no directory and inherits nothing; of
several licence files in a directory the one with the best score counts, then the smaller licence name; equal scores in a
file go to the earlier unit, then the smaller name; repeated rows are reported each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import map_rows, per_worker, small, written

THRESHOLD = 0.6
SHORT, LONG_THRESHOLD = 14, 0.75
#: Rarity among licences of a term that all have, and that counted for a term that none has.
FLOOR, OTHER = 0.1, 1.0
#: A line with at least this bound may be part of a run.
RUN_BOUND = 0.35

# Bodies of licences that are reproduced whole; terms of a whole text outweigh those of a notice in it.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."

# Short notices by SPDX name, as their licences ask for them.
TEMPLATES = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. Zero-Clause BSD License"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3"],
    "All-Rights-Reserved": ["All rights reserved.", "Copyright. All rights reserved."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Released under the Simplified BSD License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "EPL-2.0": ["This program is made available under the terms of the Eclipse Public License 2.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "ISC": ["Released under the ISC License."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_TEXTS = {
    "0BSD": [f"{_PERMISSION}. {_AS_IS}"],
    "AGPL-3.0": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "Artistic-1.0": [
        'The "Artistic License"',
        "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications.",
    ],
    "BSD-2-Clause": [f"{_BSD} {_BSD_AS_IS}"],
    "BSD-3-Clause": [f"{_BSD} {_BSD_NAMES} {_BSD_AS_IS}"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal"],
    "GFDL-1.2": ["GNU Free Documentation License Version 1.2, November 2002"],
    "GFDL-1.3": ["GNU Free Documentation License Version 1.3, 3 November 2008"],
    "GPL-1.0": [
        "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version",
    ],
    "GPL-2.0": [
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it. (Some other Free Software Foundation software is covered by the GNU Lesser General Public License instead.) You can apply it to your programs, too.",
    ],
    "GPL-3.0": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "ISC": [f"{_PERMISSION}, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS}"],
    "LGPL-2.0": [
        "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
        "it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ],
    "LGPL-2.1": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ],
    "LGPL-3.0": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "MIT": [_MIT],
    "MPL-1.1": [
        "MOZILLA PUBLIC LICENSE Version 1.1",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}
for _name, _more in _TEXTS.items():
    TEMPLATES[_name] = TEMPLATES.get(_name, []) + _more
LICENCE_FILE = r"(?i)^(?:un)?licen[cs]e|^copying|^notice|^copyright"

_TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Matcher:
    """Cosines of units of text to the templates under the documents' frequencies."""

    def __init__(self, frequency: dict[str, int], files: int):
        vocabulary = {t for texts in TEMPLATES.values() for text in texts for t in terms(text)}
        self.top = (math.log((1 + files) / 2) + 1) * OTHER  # of a term in one file and in no template
        # a term counts by its rarity among files and among licences
        among = Counter(t for texts in TEMPLATES.values() for t in {t for text in texts for t in terms(text)})
        self.idf = {t: (math.log((1 + files) / (1 + max(1, frequency.get(t, 0)))) + 1) * (math.log(len(TEMPLATES) / among[t]) + FLOOR) for t in vocabulary}
        self.templates = []
        for name in sorted(TEMPLATES):
            for text in TEMPLATES[name]:
                vector = {t: n * self.idf[t] for t, n in Counter(terms(text)).items()}
                norm = math.sqrt(sum(w * w for w in vector.values()))
                self.templates.append((name, {t: w / norm for t, w in vector.items()}))
        self.mass = [math.sqrt(len(t)) for _, t in self.templates]
        self.least = [LONG_THRESHOLD if len(t) > SHORT else THRESHOLD for _, t in self.templates]

    def bound(self, words: list[str]) -> float:
        """The most that the cosine with any template can be."""
        idf = self.idf
        known = [w for w in words if w in idf]
        if not known:
            return 0.0
        inside = sum((n * idf[t]) ** 2 for t, n in Counter(known).items())
        return math.sqrt(inside / (inside + self._rest(words, known)))

    def _rest(self, words: list[str], known: list[str]) -> float:
        if len(known) == len(words):
            return 0.0
        return sum(n * n for n in Counter(w for w in words if w not in self.idf).values()) * self.top**2

    def best(self, words: list[str]) -> tuple[float, float, str | None]:
        """(evidence, cosine, licence) of the template with the most evidence; 0 and None without a match."""
        known = Counter(w for w in words if w in self.idf)
        unit = {t: n * self.idf[t] for t, n in known.items()}
        norm = math.sqrt(sum(w * w for w in unit.values()) + self._rest(words, list(known.elements()))) or 1.0
        return self._chosen([sum(w * template[t] for t, w in unit.items() if t in template) / norm for _, template in self.templates])

    def _chosen(self, cosines: list[float]) -> tuple[float, float, str | None]:
        top: tuple[float, float, str | None] = (0.0, 0.0, None)
        for k, cosine in enumerate(cosines):
            # names stand in order, so ties go to the smaller
            if cosine >= self.least[k] and cosine * self.mass[k] > top[0] + 1e-12:
                top = (cosine * self.mass[k], cosine, self.templates[k][0])
        return top

    def best_sequence(self, run: list[tuple[int, list[str]]]) -> tuple[tuple[float, float, str | None], int]:
        """The best of all sequences of neighbouring paragraphs: products with a template add up, norms by term."""
        counts = [Counter(words) for _, words in run]
        products = [[sum(n * self.idf[w] * template[w] for w, n in c.items() if w in template) for _, template in self.templates] for c in counts]
        top, line = (0.0, 0.0, None), 0
        for i, (start, _) in enumerate(run):
            seen: Counter = Counter()
            norm2, total = 0.0, [0.0] * len(self.templates)
            for j in range(i, len(run)):
                for w, n in counts[j].items():
                    norm2 += (2 * seen[w] + n) * n * self.idf.get(w, self.top) ** 2
                    seen[w] += n
                total = [x + y for x, y in zip(total, products[j])]
                norm = math.sqrt(norm2)
                found = self._chosen([x / norm for x in total])
                if found[0] > top[0] + 1e-12:
                    top, line = found, start
        return top, line

    def of_file(self, text: str | None) -> tuple[str | None, float | None, int | None]:
        """(licence, cosine, line) of the match with the most evidence; a whole file counts as line 0."""
        if not text:
            return None, None, None
        best, at_line = (0.0, 0.0, None), 0
        run: list[tuple[int, list[str]]] = []  # paragraphs: first line, words
        lines, broken, whole = 0, False, []
        for at, line in enumerate([*text.split("\n"), None]):
            words = terms(line) if line is not None else []
            whole += words
            if line is not None and not words:
                broken = True
                continue
            bound = self.bound(words)
            if bound >= THRESHOLD:
                found = self.best(words)
                if found[0] > best[0] + 1e-12:
                    best, at_line = found, at
            if bound >= RUN_BOUND:
                if not run or broken:
                    run.append((at, []))
                run[-1][1].extend(words)
                lines, broken = lines + 1, False
                continue
            if lines > 1:
                found, start = self.best_sequence(run)
                if found[0] > best[0] + 1e-12:
                    best, at_line = found, start
            run, lines, broken = [], 0, False
        if "\n" in text and self.bound(whole) >= THRESHOLD:
            found = self.best(whole)
            if found[0] > best[0] + 1e-12:
                best, at_line = found, 0
        return (best[2], best[1], at_line) if best[2] else (None, None, None)


def term_frequencies(files: DataFrame) -> dict[str, int]:
    """In how many files each term of the templates stands: a table of the templates' size."""

    def start():
        vocabulary = {t for texts in TEMPLATES.values() for text in texts for t in terms(text)}

        def step(texts):
            found = Counter(t for text in texts if text for t in vocabulary.intersection(terms(text)))
            return list(found), list(found.values())

        return step

    counted = map_rows(files.select("text"), start, "term string, n long", rows=1024).groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counted.collect()}


def _matcher(sent: bytes) -> Matcher:
    return per_worker(("matcher", sent), lambda: Matcher(*pickle.loads(sent)))


def scan(files: DataFrame) -> DataFrame:
    """files (doc_id, path, text) to doc_id, path, licence, score, line, origin (header, file, inherited), from_dir."""
    files = files.select("doc_id", "path", "text")
    model = files.sparkSession.sparkContext.broadcast(pickle.dumps((term_frequencies(files), files.count())))

    def start():
        matcher = _matcher(model.value)

        def step(doc_ids, paths, texts):
            found = [matcher.of_file(t) for t in texts]
            return doc_ids, paths, *[[f[k] for f in found] for k in range(3)]

        return step

    own = written(map_rows(files, start, "doc_id long, path string, licence string, score double, line int", rows=256), "own")
    own = own.withColumns({"dir": F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "name": F.regexp_extract("path", r"([^/]*)$", 1)})
    is_file = F.coalesce(F.col("name").rlike(LICENCE_FILE), F.lit(False))

    # one row per directory that declares a licence
    first = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("score"), "licence"))
    declared = own.where(is_file & F.col("licence").isNotNull()).groupBy("dir", "licence").agg(F.max("score").alias("score"))
    declared = written(declared.withColumn("r", first).where("r = 1").select(F.col("dir").alias("from_dir"), F.col("licence").alias("declared"), F.col("score").alias("declared_score")), "declared")

    # ancestors of directories, nearest first; a directory has as many as its path has parts
    parts = F.split("dir", "/")
    lacking = own.where(F.col("licence").isNull() & F.col("path").isNotNull()).select("dir").distinct()
    up = lacking.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("a")))).alias("u"))
    up = up.select("dir", "u.depth", F.col("u.a").alias("from_dir"))
    near = up.join(small(declared), "from_dir").groupBy("dir").agg(F.max_by(F.struct("declared", "declared_score", "from_dir"), "depth").alias("d"))
    near = written(near.select("dir", "d.*"), "near")

    out = own.join(small(near), (own["dir"] == near["dir"]) & own["licence"].isNull() & own["path"].isNotNull(), "left").drop(near["dir"])
    origin = F.when(F.col("licence").isNotNull(), F.when(is_file, "file").otherwise("header")).when(F.col("declared").isNotNull(), "inherited")
    return out.select("doc_id", "path", F.coalesce("licence", "declared").alias("licence"), F.round(F.coalesce("score", "declared_score"), 6).alias("score"), "line", origin.alias("origin"), "from_dir")
