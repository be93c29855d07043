"""Licence scans with DataFrame functions alone.

A text is normalised (lower case, runs of anything but letters and digits become one space) and cut into word bigrams.
Every window of a template's size is compared to that template by Dice's coefficient over bigrams, as bags: 2 * common /
(bigrams of the window + bigrams of the template); windows may begin anywhere, so notices inside lines, across lines and
in the middle of paragraphs are found, and whole licence texts are templates like short notices. A text with fewer bigrams
than the template is compared as a whole.

Bounds prune what is compared: a text of n bigrams reaches the threshold t only with templates of up to n * (2 - t) / t, and
a window needs t times the mean of both sizes in bigrams that occur in some template at all; so texts without such a crowd
of known bigrams, nearly all, go after one set lookup a bigram, and each of the others meets the templates that
its crowds allow. Of windows of one template the best counts (of equal ones the last); of windows that overlap the best
stays (of equal ones the lesser licence, the earlier window, the first template). Everything is a projection of one row,
without a shuffle or join.

Null or empty texts give no rows. A repeated row gives its rows again. Texts of any length are scanned whole. Only doc_id
and text are read.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names by which notices call licences, and the forms of such notices.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL-3.0"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
    "Zlib": ["zlib License"],
}
FORMS = ["licensed under the {}", "released under the {}", "distributed under the {}", "under the terms of the {}", "licensed under {}", "SPDX-License-Identifier: {}"]
_SHORT = re.compile(r"^(CC BY|[A-Za-z]+-[0-9])")  # names that go without an article

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {what} is free software{semi} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{either} version {version} of the License, or (at your option) any later version."""


def _gnu(what: str, kind: str, version: str, late: bool) -> str:
    return _GNU.format(what=what, kind=kind, version=version, semi=":" if late else ";", either=", either" if late else "; either")


#: Licence texts and the notices that they ask for, as published.
TEXTS = [
    ("MIT", f"{_MIT} {_MIT_AS_IS}"),
    ("MIT", _MIT),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_AS_IS}"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", _gnu("program", "", "2", False)),
    ("GPL-3.0", _gnu("program", "", "3", True)),
    ("LGPL-2.1", _gnu("library", "Lesser ", "2.1", False)),
    ("LGPL-3.0", _gnu("library", "Lesser ", "3", True)),
    ("AGPL-3.0", _gnu("program", "Affero ", "3", True)),
]
TEMPLATES = [(license, form.format(name)) for license, names in NAMES.items() for name in names for form in FORMS if ("the {}" in form) != bool(_SHORT.match(name)) and ("SPDX" not in form or name == license)] + TEXTS
THRESHOLD = 0.8


def normal(text: str) -> list[str]:
    """A template's words."""
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bag(words: list[str]) -> list[str]:
    """The bigrams of words; the k-th of equal ones, from the second, is marked by k."""
    seen: Counter = Counter()
    out = []
    for a, b in zip(words, words[1:], strict=False):
        seen[f"{a} {b}"] += 1
        out.append(f"{a} {b}" if seen[f"{a} {b}"] == 1 else f"{a} {b}#{seen[f'{a} {b}']}")
    return out


_NORMAL = r"trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' '))"


def _bag(words: str) -> str:
    """SQL: the same of an array of words."""
    pairs = "transform(slice(z, 1, size(z) - 1), (v, k) -> concat(v, ' ', element_at(z, k + 2)))"
    marked = "transform(b, (v, k) -> if(array_position(b, v) = k + 1, v, concat(v, '#', size(filter(slice(b, 1, k + 1), u -> u = v)))))"
    return f"element_at(transform(array({words}), z -> element_at(transform(array({pairs}), b -> if(size(array_distinct(b)) = size(b), b, {marked})), 1)), 1)"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, word, n_words, dice): passages that state a licence. word counts from 1."""
    bags = [(i, license, bag(normal(text))) for i, (license, text) in enumerate(TEMPLATES if templates is None else templates)]
    bags = [(i, license, b) for i, license, b in bags if b]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    if not bags:
        return rows.selectExpr("doc_id", "'' license", "1 word", "0 n_words", "0D dice").where("false")
    known = sorted({" ".join(x.split("#")[0].split()) for *_, b in bags for x in b})
    least = min(len(b) for *_, b in bags)
    crowd = lambda h: F.size(h) >= threshold * least / (2 - threshold)
    if threshold >= 0.8 and least > 3:  # where 8 in 10 are known, some 4 lie within 5 places
        crowd = lambda h: (F.size(h) > 3) & F.exists(F.sequence(F.lit(0), F.size(h) - 4), lambda j: F.get(h, j + 3) - F.get(h, j) <= 4)
    # places (from 0) of known bigrams, null without a crowd of them; words and places are bound once, as lambda variables
    bound = lambda value, use: F.get(F.transform(F.array(value), use), 0)
    hits = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)).isin(known))
    words = F.split(F.expr(_NORMAL), " ")
    found = bound(words, lambda w: F.when(F.size(w) > 1, bound(hits(w), lambda h: F.when(crowd(h), h))))
    dense = rows.withColumn("h", found).where("h is not null").select("doc_id", words.alias("w"), "h").withColumn("n", F.size("w") - 1)
    # one literal for all templates, which the optimizer folds: thousands of literals would take longer to plan than to run
    table = F.from_json(F.lit(json.dumps([{"i": i, "license": license, "m": len(b), "bag": b} for i, license, b in bags])), "array<struct<i: int, license: string, m: int, bag: array<string>>>")
    fits = dense.select("doc_id", "w", "h", "n", F.filter(table, lambda t: (F.size("h") >= threshold * (t["m"] + F.least(t["m"], F.col("n"))) / 2)).alias("templates"))
    # own: places of a template's bigrams; a best window begins at one of them, or is the last
    own = "filter(h, i -> array_contains(t.bag, concat(w[i], ' ', w[i + 1])))"
    starts = "array_union(filter(o, i -> i <= n - t.m), array(greatest(n - t.m, 0)))"
    rich = f"filter({starts}, s -> size(filter(o, i -> i >= s and i < s + t.m)) >= {threshold} * (t.m + least(t.m, n)) / 2)"
    scored = f"transform({rich}, s -> struct(size(array_intersect({_bag('slice(w, s + 1, least(t.m, n) + 1)')}, t.bag)) * 2D / (t.m + least(t.m, n)) as dice, s as s))"
    best = f"array_max(element_at(transform(array({own}), o -> {scored}), 1))"
    each = fits.selectExpr("doc_id", f"filter(transform(templates, t -> struct(t.i as i, t.license as license, least(t.m, n) + 1 as n_words, {best} as best)), x -> x.best.dice >= {threshold}) as x")
    # no filter on x: it would be pushed below the columns it is made of, and these be computed anew for each reference
    overlap = "y.best.s < a.best.s + a.n_words and a.best.s < y.best.s + y.n_words"
    wins = "y.best.dice > a.best.dice or (y.best.dice = a.best.dice and (y.license < a.license or (y.license = a.license and (y.best.s < a.best.s or (y.best.s = a.best.s and y.i < a.i)))))"
    return each.selectExpr("doc_id", f"explode(filter(x, a -> not exists(x, y -> {overlap} and ({wins})))) a").selectExpr("doc_id", "a.license", "a.best.s + 1 word", "a.n_words", "a.best.dice")
