"""The matcher against plain cosines, on notices and licence files, and the scan on odd rows."""

import math
import random
from collections import Counter
from pathlib import Path

import pytest

from codestrata.llm import licenses as x

NOTICES = {
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "it under the terms of the GNU Lesser General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or",
    "AGPL-3.0": "it under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "All-Rights-Reserved": "Copyright 2020 by somebody. All rights reserved.",
}


@pytest.mark.parametrize("name", NOTICES)
def test_notice(name):
    found = x.Matcher({}, 1000).of_file("int a;\n\n" + NOTICES[name] + "\n\nint main() { return 0; }\n")
    assert found[0] == name and found[1] >= x.THRESHOLD


#: Licence files of the system, where it has them.
FILES = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


@pytest.mark.parametrize("name", FILES)
def test_whole_file(name):
    path = Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("the system has no such file")
    assert x.Matcher({}, 1000).of_file(path.read_text())[0] == FILES[name]


def test_best_equals_plain_cosines():
    m = x.Matcher({"license": 40, "the": 900, "software": 3}, 1000)
    r = random.Random(4)
    vocabulary = sorted(m.idf)
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(1, 20))] + ["unheard"] * r.randint(0, 3) + x.terms(r.choice(x.TEMPLATES[r.choice(sorted(x.TEMPLATES))]))
        best = (0.0, 0.0, None)
        for name in sorted(x.TEMPLATES):
            for text in x.TEMPLATES[name]:
                a = {t: n * m.idf.get(t, m.top) for t, n in Counter(words).items()}
                b = {t: n * m.idf[t] for t, n in Counter(x.terms(text)).items()}
                cosine = sum(a.get(t, 0) * w for t, w in b.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))
                if cosine >= (x.LONG_THRESHOLD if len(b) > x.SHORT else x.THRESHOLD) and cosine * math.sqrt(len(b)) > best[0] + 1e-12:
                    best = (cosine * math.sqrt(len(b)), cosine, name)
        got = m.best(words)
        assert got[2] == best[2]
        assert got[1] == pytest.approx(best[1])
        assert m.bound(words) >= best[1] - 1e-9


def test_odd_rows(spark):
    both = NOTICES["MPL-2.0"]
    rows = [(1, "a/LICENSE", both), (2, "a/COPYING", NOTICES["LGPL-3.0"]), (3, "a/x.py", "word " * 300_000), (3, "a/x.py", "word " * 300_000), (4, None, None), (5, "b/c.py", "")]
    files = spark.createDataFrame([(*r, "own", "own") for r in rows], "doc_id long, path string, text string, licence string, score string")
    got = sorted((r["doc_id"], r["licence"], r["origin"]) for r in x.scan(files).collect())
    # of two licence files of a directory the better score counts
    assert got == [(1, "MPL-2.0", "file"), (2, "LGPL-3.0", "file"), (3, "MPL-2.0", "inherited"), (3, "MPL-2.0", "inherited"), (4, None, None), (5, None, None)]
