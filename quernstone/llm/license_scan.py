"""Licence scan: Dice coefficient over word bigrams between pieces of a text and licence templates.

Pieces and templates are lower-cased and runs of anything but letters and digits become one space; what is compared are
sets of bigrams A and B: 2 |A and B| / (|A| + |B|) must reach ``DICE``. Pieces are the whole text, its paragraphs (parted
by a blank line) and its lines, each against all templates; and for each template all stretches of as many words as
it has, begun at every word, wherever a notice stands and however it is wrapped or marked as a comment. A piece is only compared with a template if |A| lies in
[t / (2 - t) |B|, (2 - t) / t |B|]; outside, no overlap can reach t.

Before any of this a text must hold one of a few words, chosen so that for each template fewer bigrams are without such
a word than a match needs in common; and the bigrams of the whole text must hold as many of a template's as a match
needs. Of the stretches only those are compared that hold as many places with a bigram of the template: they follow from
the list of these places, of which the k-th and the one ``needed`` further must lie within a stretch. None of this loses a match.

All of it is built-in expressions over one row at a time: no shuffle, no join, no Python. A null or empty text
has no pieces. Equal scores go to the template first by name. Repeated rows are each scanned.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICE = 0.8

# Licence texts and notices, by SPDX identifier (public texts; holders and years left out).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSL-1.0", 'Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)'),
    ("CC0-1.0", 'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is published under CC0 1.0 Universal.'),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", "This is free software; you can redistribute it and/or modify it under the same terms as the Perl 5 programming language system itself."),
    ("Artistic-2.0", "This is free software, licensed under: The Artistic License 2.0 (GPL Compatible)"),
    ("AGPL-3.0-or-later", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.'),
    ("EPL-2.0", 'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/'),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-2.1-or-later", 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.'),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE. TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION. 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
# Identifiers that stand in tags of source files.
TAGGED = ("0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {name}") for name in TAGGED)


# Words too common in English to stand for a licence.
COMMON = frozenset("a all an and any are as at be but by copy file for form found free from if in into is it its may must no not of on one only or other out part see such terms that the this to under use version with work you your".split())


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def needed(size: int, dice: float) -> int:
    """Bigrams of a template that any match has in common with it: overlap >= t (|A| + |B|) / 2 and |A| >= overlap."""
    return math.ceil(dice * size / (2 - dice) - 1e-9)


def triggers(templates: list[list[str]], dice: float) -> list[str]:
    """Few words, none of them common if it can be helped, such that no template can be matched without one of them."""
    chosen: list[str] = []

    def open_ones() -> list[list[str]]:
        left = ([b for b in t if not set(b.split()) & set(chosen)] for t in templates)
        return [rest for rest, t in zip(left, templates, strict=True) if len(rest) >= needed(len(t), dice)]

    while rest := open_ones():
        covers = Counter(w for t in rest for b in t for w in set(b.split()))
        chosen.append(max(covers, key=lambda w: (w not in COMMON and not w.isdigit(), covers[w] * len(w), w)))
    return sorted(chosen)


def n_words(text: str) -> int:
    return len(re.sub(r"[^a-z0-9]+", " ", text.lower()).split())


def _pieces(text: Column) -> Column:
    return F.array_distinct(F.concat(F.array(text), F.split(text, "\n[ \t]*\n"), F.split(text, "\n")))


def _grams(w: Column) -> Column:
    """The bigram at every place of an array of two words or more."""
    return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def _starts(places: Column, needed: Column, grams: Column, last: Column) -> Column:
    """Where stretches of so many bigrams begin that hold needed of the places (ascending, needed at least). Start s is reached from the
    first place at or after it, so each is made once."""

    def from_place(k: Column) -> Column:
        here, end = F.element_at(places, k), F.element_at(places, k + needed - 1)
        low = F.greatest(F.lit(1), end - grams + 1, F.when(k > 1, F.element_at(places, F.greatest(k - 1, F.lit(1))) + 1))
        high = F.least(here, last)
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(places) - needed + 1)), from_place))


def _dice(a: Column, b: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def scan(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """Per row: doc_id, licenses (names of all matches, sorted, comma-joined), n_licenses, best_license, best_dice."""
    named = sorted((name, template_bigrams(text), n_words(text)) for name, text in templates)
    words = triggers([b for _, b, _ in named], dice)
    trigger = f"(?i)(?<![\\p{{L}}\\p{{N}}])({'|'.join(words)})(?![\\p{{L}}\\p{{N}}])"
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, b)).alias("b"), F.lit(m).alias("m"), F.lit(needed(len(b), dice)).alias("needed")) for name, b, m in named])
    every = sorted({x for _, b, _ in named for x in b})
    low, high = dice / (2 - dice), (2 - dice) / dice
    tidy = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " ")), " ")
    fits = lambda a, t: (F.size(a) >= low * F.size(t["b"]) - 1e-9) & (F.size(a) <= high * F.size(t["b"]) + 1e-9)
    hits = lambda a, t: F.struct(_dice(a, t["b"]).alias("dice"), t["name"].alias("name"))
    none = F.array().cast("array<struct<dice:double,name:string>>")

    rows = docs.select(docs[doc_col].alias("doc_id"), F.when(docs[text_col].rlike(trigger), docs[text_col]).alias("__text"))
    rows = rows.select("doc_id", "__text", tidy(F.col("__text")).alias("__words"))
    # The places of bigrams of any template, then the templates of which the text has enough.
    rows = rows.select("doc_id", "__text", F.when(F.size("__words") > 1, _grams(F.col("__words"))).alias("__grams"))
    placed = F.filter(F.transform("__grams", lambda g, i: F.struct((i + 1).alias("i"), g.alias("g"))), lambda x: x["g"].isin(every))
    rows = rows.select("doc_id", "__text", "__grams", placed.alias("__at"))
    rows = rows.select("*", F.when(F.size("__at") > 0, F.array_distinct(F.transform("__at", lambda x: x["g"]))).alias("__has"))
    rows = rows.select("doc_id", "__text", "__grams", "__at", F.when(F.size("__has") > 0, F.filter(known, lambda t: F.size(F.array_intersect(t["b"], F.col("__has"))) >= t["needed"])).alias("__near"))
    some = F.size("__near") > 0
    sets = F.transform(F.filter(F.transform(_pieces(F.col("__text")), tidy), lambda w: F.size(w) > 1), lambda w: F.array_distinct(_grams(w)))
    of_pieces = F.flatten(F.transform(F.array_distinct(sets), lambda a: F.transform(F.filter(F.col("__near"), lambda t: fits(a, t)), lambda t: hits(a, t))))

    def of_stretches(t: Column) -> Column:
        grams = F.least(t["m"] - 1, F.size("__grams"))
        places = F.transform(F.filter("__at", lambda x: F.array_contains(t["b"], x["g"])), lambda x: x["i"])
        starts = _starts(places, t["needed"], grams, F.size("__grams") - grams + 1)
        return F.transform(starts, lambda i: hits(F.array_distinct(F.slice("__grams", i, grams)), t))

    found = F.filter(F.concat(of_pieces, F.flatten(F.transform("__near", of_stretches))), lambda m: m["dice"] >= dice)
    rows = rows.select("doc_id", F.when(some, found).otherwise(none).alias("m"))
    best = F.aggregate("m", F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("name")), lambda acc, m: F.when((m["dice"] > acc["dice"]) | ((m["dice"] == acc["dice"]) & (m["name"] < acc["name"])), m).otherwise(acc))
    names = F.array_sort(F.array_distinct(F.transform("m", lambda m: m["name"])))
    return rows.select("doc_id", F.array_join(names, ",").alias("licenses"), F.size(names).cast("bigint").alias("n_licenses"), best["name"].alias("best_license"), F.round(best["dice"], 6).alias("best_dice"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """The same by brute force: every piece and every stretch against every template."""
    known = ", ".join(f"({_quoted(name)}, [{', '.join(map(_quoted, template_bigrams(text)))}], {n_words(text)})" for name, text in TEMPLATES)
    low, high = DICE / (2 - DICE), (2 - DICE) / DICE
    return rf"""
WITH known(name, b, m) AS (VALUES {known}),
whole AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
has AS (SELECT doc_id, w, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM whole WHERE len(w) > 1),
close AS (SELECT doc_id, name, b, m, w FROM has, known WHERE len(list_intersect(a, b)) >= {low}::DOUBLE * len(b) - 1e-9::DOUBLE),
starts AS (SELECT *, unnest(range(1, greatest(1, len(w) - m + 1) + 1)) AS i FROM close),
stretches AS (SELECT DISTINCT doc_id, name, b, w[i : i + m - 1] AS w FROM starts),
pieces AS (
  SELECT DISTINCT doc_id, string_split(trim(regexp_replace(lower(p), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w
  FROM (SELECT doc_id, unnest(list_concat([text], string_split_regex(text, '\n[ \t]*\n'), string_split(text, chr(10)))) AS p FROM documents WHERE text IS NOT NULL)),
pairs AS (SELECT p.doc_id, k.name, k.b, p.w FROM pieces p JOIN close k ON p.doc_id = k.doc_id WHERE len(p.w) > 1 UNION ALL SELECT doc_id, name, b, w FROM stretches),
sets AS (SELECT doc_id, name, b, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM pairs),
found AS (
  SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM sets WHERE len(a) BETWEEN {low}::DOUBLE * len(b) - 1e-9::DOUBLE AND {high}::DOUBLE * len(b) + 1e-9::DOUBLE),
hits AS (SELECT * FROM found WHERE dice >= {DICE}::DOUBLE),
best AS (SELECT doc_id, name, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, encode(name)) AS r FROM hits),
listed AS (SELECT doc_id, string_agg(name, ',' ORDER BY encode(name)) AS licenses, count(*) AS n FROM (SELECT DISTINCT doc_id, name FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.licenses, '') AS licenses, coalesce(l.n, 0)::BIGINT AS n_licenses, b.name AS best_license, round(coalesce(b.dice, 0), 6)::DOUBLE AS best_dice
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN best b ON d.doc_id = b.doc_id AND b.r = 1
"""
