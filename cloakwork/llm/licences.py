"""Licence scans: Dice coefficient over word bigrams against templates, pruned by size.

A passage of b bigrams and a template of a bigrams share at most min(a, b), so a
Dice coefficient of at least t needs a * t / (2 - t) <= b <= a * (2 - t) / t, and
at least t / (2 - t) * a bigrams in common. Templates that a text can't meet by
these bounds are dropped before anything is compared. For the rest, passages
start and end at words that begin or end a template bigram: widening a passage
by words outside the template only lowers its coefficient. Starts are tried from
the highest bound down (as if each shared bigram counted), until no bound exceeds
the best coefficient found; what lies before and after that passage is searched
again, so no more than one passage of each part is ever held.

Defined results
* One row per (document, match): of overlapping passages the one of the highest
  coefficient stays (then the longer, then the earlier, then the template by
  name). Null and empty texts match nothing.
* Words are lower case, without punctuation; lines that begin with a copyright
  notice aren't compared. first_word and n_words count the words that are.
* Repeated rows give repeated matches. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
    " conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and"
    " the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
    " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_DISCLAIMER = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED'
    " TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR"
    " CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,"
    " PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF"
    " LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS"
    " SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Public licence notices as their stewards publish them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the'
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable"
        ' law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT'
        " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
        " permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation the'
        " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
        " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and"
        " this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED"
        ' "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF'
        " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT"
        " HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
        " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        ' provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"'
        " AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY"
        " AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY"
        " DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER"
        " TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and"
        " the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
        " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-2-Clause-full": _BSD + _BSD_DISCLAIMER,
    "BSD-3-Clause-text": _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission." + _BSD_DISCLAIMER,
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or"
        " distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any"
        " means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in"
        " the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and"
        " successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software"
        ' under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,"
        " DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR"
        " THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
        " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
        " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
}


#: Families of the GNU licences, their versions, and what a notice calls them.
_GNU = {"GPL": (("1", "2", "3"), "GNU General Public License"), "LGPL": (("2", "2.1", "3"), "GNU Lesser General Public License"), "AGPL": (("3",), "GNU Affero General Public License")}


def _notices() -> dict[str, str]:
    """The usual notices of each family and version."""
    out = {}
    for family, (versions, title) in _GNU.items():
        for v in versions:
            name = f"{family}-{v}" + ("" if "." in v else ".0")
            out.setdefault(f"{name}-work", f"This work is licensed under the {title}, version {v}.")
            out[f"{name}-notice"] = f"Licensed under the {title} v{name.split('-')[1]}."
            out[f"{name}-later"] = (
                f"This program is free software; you can redistribute it and/or modify it under the terms of the {title} as published by the Free"
                f" Software Foundation; either version {v} of the License, or (at your option) any later version. This program is distributed in the"
                " hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
                f" PARTICULAR PURPOSE. See the {title} for more details."
            )
    for kind in ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND"):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out[f"CC-{kind}-{v}"] = f"Licensed under CC {kind} {v}."
    for name in ("BSD 2-Clause", "BSD 3-Clause", "ISC"):
        out[f"{name.replace(' ', '-')}"] = f"Released under the {name} License."
    return out


TEMPLATES |= {k: t for k, t in _notices().items() if t not in TEMPLATES.values()}
TEMPLATES |= {f"{f.stem}-full": f.read_text("utf-8") for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


_COPYRIGHT = re.compile(r"^[^\w\n(©]*(?:copyright\b|\(c\)|©)[^\n]*$", re.I | re.M)


def normalise(text: str | None) -> list[str]:
    if not text:
        return []
    return _WORD.findall((_COPYRIGHT.sub("", text) if "opyright" in text or "OPYRIGHT" in text or "(" in text or "©" in text else text).lower())


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Templates:
    def __init__(self, texts: dict[str, str], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.grams = {k: Counter(bigrams(normalise(t))) for k, t in texts.items()}
        self.by_gram: dict[tuple[str, str], list[str]] = {}
        for k, grams in self.grams.items():
            for g in grams:
                self.by_gram.setdefault(g, []).append(k)

    def matches(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, first word, words) of the passages kept."""
        words = normalise(text)
        grams = bigrams(words)
        hits: dict[str, list[int]] = {}
        known = self.by_gram
        for i, g in enumerate(grams):
            if g in known:
                for k in known[g]:
                    hits.setdefault(k, []).append(i)
        low = self.threshold / (2 - self.threshold)
        places = {k: np.array(at) for k, at in hits.items() if len(at) >= low * self.grams[k].total()}
        # best first: a start waits under its bound until it is looked at, then under the best passage that it has room for
        queue = [(-bound - 1e-11, 0, int(at[x]), k, x) for k, at in places.items() for x, bound in self.bounds(k, at)]
        heapify(queue)
        firsts, ends, out = [], [], []  # of the passages taken, in order
        while queue:
            d, n, start, k, x = heappop(queue)
            i = bisect_right(firsts, start)
            if i and ends[i - 1] > start:
                continue
            room = firsts[i] if i < len(firsts) else len(words)
            if n and start - n <= room:
                firsts.insert(i, start)
                ends.insert(i, start - n)
                out.append((k, -d, start, -n))
            elif (found := self.best(k, places[k], x, room, grams)) is not None:
                heappush(queue, (*found, start, k, x))
        return sorted(out, key=lambda m: m[2])

    def bounds(self, k: str, at: np.ndarray) -> list[tuple[int, float]]:
        """The places in `at` where a passage of template k may start, and the most that it can reach: each of its bigrams counted as common."""
        size = self.grams[k].total()
        low, high = self.threshold / (2 - self.threshold), (2 - self.threshold) / self.threshold
        need, widest = int(-(-size * low // 1)), int(size * high)
        most = np.zeros(len(at))
        if not need or len(at) < need:
            return []
        j = need - 1
        while j < len(at):
            width = at[j:] - at[: len(at) - j] + 1
            fits = width <= widest
            if not fits.any():
                break
            bound = np.where(fits & (width >= size * low), 2 * min(j + 1, size) / (size + width), 0.0)
            np.maximum(most[: len(bound)], bound, out=most[: len(bound)])
            j += 1
        good = np.flatnonzero(most >= self.threshold - 1e-11)
        return list(zip(good.tolist(), most[good].tolist()))

    def best(self, k: str, at: np.ndarray, x: int, room: int, grams: list[tuple[str, str]]) -> tuple[float, int] | None:
        """(-coefficient, -words) of the best passage of template k that starts with the bigram at[x] and ends before the word room."""
        a = self.grams[k]
        size, common, left, best = a.total(), 0, {}, None
        low, high = self.threshold / (2 - self.threshold), (2 - self.threshold) / self.threshold
        start = int(at[x])
        last = min(start + int(size * high), room - 1)
        for y in at[x : np.searchsorted(at, last)].tolist():
            g = grams[y]
            if (n := left.get(g, a[g])) > 0:
                left[g] = n - 1
                common += 1
            width = y - start + 1
            d = 2 * common / (size + width)
            if width >= size * low and d >= self.threshold:
                found = -round(d, 12), -(width + 1)
                if best is None or found < best:
                    best = found
        return best


def scan(docs: DataFrame, texts: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence, dice, first_word, n_words. texts: the templates by name (TEMPLATES, if none are given)."""
    sent = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if texts is None else texts, threshold))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, *m) for d, t in zip(pdf["doc_id"], pdf["text"]) for m in sent.value.matches(t)]
            yield pd.DataFrame(out, columns=["doc_id", "licence", "dice", "first_word", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, licence string, dice double, first_word int, n_words int")
