"""License scans: normalised text compared to licence templates by the Dice coefficient over word bigrams.

A text's units are its lines, its paragraphs (parted by empty lines) and the whole of it. A unit is
normalised (lower case, runs of anything but letters, digits and . + - to single spaces, full stops at ends of words
dropped) and becomes its set of word bigrams. It matches the template with the highest
2 * common / (sum of sizes) if that is at least THRESHOLD; sizes bound it beforehand: the smaller
set must have at least THRESHOLD / (2 - THRESHOLD) of the larger one's bigrams. The unit must also name the template's version and
qualifiers (such as lesser or noncommercial), all of them and no others, and must not deny the licence ("not licensed"). Licences that share their best template
word for word are all named ("a or b"), unless other units of the text settle which of them it is.

Most units are pruned exactly before any bigram is made: for each template some words are chosen so that the
bigrams without any of them are too few for a match, and a unit with none of the chosen words is left out.
Everything is done inside the row with DataFrame functions; nothing is shuffled.

Defined cases: a null or empty text has no matches; a unit of one word has no bigrams and matches
nothing; ties are named together, in the order of names; repeated lines are one unit; repeated rows get the
same answer; other columns are ignored; null ids stay null; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = Fraction(4, 5)

#: The customary texts of public licences, from their stewards' publications.
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "3. This notice may not be removed or altered from any source distribution.",
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
)
_GRANT = "This {work} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{mark} either version {version} of the License, or (at your option) any later version."
_HOPE = "This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."

#: The words and the code of each Creative Commons licence, and what its versions are called.
_CC = (("Attribution", "BY"), ("Attribution-ShareAlike", "BY-SA"), ("Attribution-NonCommercial", "BY-NC"), ("Attribution-NoDerivatives", "BY-ND"), ("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"), ("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"))
_CC_VERSIONS = (("3.0", "Unported"), ("4.0", "International"))

#: (license, text): its notices, paragraphs and, for short licences, the whole body. A paragraph that several licences share is listed for each.
TEMPLATES = (
    ("0bsd", _ISC[0].partition(", provided")[0]),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3."),
    ("agpl-3.0", _GRANT.format(work="program", stop=":", kind="Affero ", mark=",", version="3")),
    ("agpl-3.0", _HOPE.format(work="program", kind="Affero ")),
    ("all-rights-reserved", "All rights reserved."),
    *((f"apache-{v}", f"Licensed under the Apache License, Version {v}.") for v in ("1.0", "1.1", "2.0")),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    *(("apache-2.0", text) for text in (*_APACHE, " ".join((_APACHE[0], "http://www.apache.org/licenses/LICENSE-2.0", _APACHE[1])))),
    *((name, text) for name in ("bsd-2-clause", "bsd-3-clause") for text in (*_BSD, "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.")),
    ("bsd-2-clause", " ".join(_BSD)),
    ("bsd-3-clause", _BSD_THIRD),
    ("bsd-3-clause", " ".join((*_BSD[:3], _BSD_THIRD, _BSD[3]))),
    *((f"cc-{code.lower()}-{v}", text) for words, code in _CC for v, kind in _CC_VERSIONS for text in (f"Licensed under CC {code} {v}.", f"This work is licensed under a Creative Commons {words} {v} {kind} License.")),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("epl-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("gpl-1.0", "This work is licensed under the GNU General Public License, version 1."),
    ("gpl-1.0", _GRANT.format(work="program", stop=";", kind="", mark=";", version="1")),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", _GRANT.format(work="program", stop=";", kind="", mark=";", version="2")),
    ("gpl-2.0", _HOPE.format(work="program", kind="")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", _GRANT.format(work="program", stop=":", kind="", mark=",", version="3")),
    ("gpl-3.0", _HOPE.format(work="program", kind="")),
    ("isc", _ISC[0]),
    ("isc", _ISC[1]),
    ("isc", " ".join(_ISC)),
    ("lgpl-2.0", _GRANT.format(work="library", stop=";", kind="Library ", mark=";", version="2")),
    ("lgpl-2.1", _GRANT.format(work="library", stop=";", kind="Lesser ", mark=";", version="2.1")),
    ("lgpl-2.1", _HOPE.format(work="library", kind="Lesser ")),
    ("lgpl-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl-3.0", _GRANT.format(work="library", stop=":", kind="Lesser ", mark=",", version="3")),
    ("lgpl-3.0", _HOPE.format(work="library", kind="Lesser ")),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", _MIT[0].partition(", and to permit")[0]),
    *(("mit", text) for text in (*_MIT, " ".join(_MIT))),
    ("mpl-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/'),
    *((f"mpl-{v}", f"This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}.") for v in ("1.0", "1.1", "2.0")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *(("unlicense", text) for text in (*_UNLICENSE, " ".join(_UNLICENSE))),
    *(("zlib", text) for text in (*_ZLIB, " ".join(_ZLIB))),
)

#: Words that a version's number follows, words that tell licences of one family apart, and what a negation turns round.
_BEFORE_VERSION = tuple("version v license by by-sa by-nc by-nd by-nc-sa by-nc-nd attribution attribution-sharealike attribution-noncommercial attribution-noderivatives attribution-noncommercial-sharealike attribution-noncommercial-noderivatives noderivatives sharealike noncommercial by-noderivatives by-sharealike by-noncommercial by-noderivs gpl lgpl agpl mpl apache".split())
_QUALIFIERS = tuple("affero lesser library sharealike noncommercial noderivatives noderivs sa nc nd".split())
_NEGATED = tuple(f"{no} {what}" for no in ("not", "never", "longer", "t") for what in "licensed released governed subject under covered available granted free dedicated".split())
_VERSION, _V_VERSION = r"^[0-9]+([.][0-9]+)*$", r"^v[0-9]+([.][0-9]+)*$"

_DROPPED = "[^\\p{L}\\p{N}.+-]+"


def _plain_words(text: str) -> list[str]:
    """Words of a template; the same rules as `words_of_unit`, for the few template texts."""
    kept = "".join(c if c.isalnum() or c in ".+-" else " " for c in text.lower())
    return [w for w in (w.rstrip(".") for w in kept.split()) if w]


def _plain_bigrams(text: str) -> list[str]:
    words = _plain_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _plain_marks(text: str) -> list[str]:
    """What tells a template from others of its family, as by `marks_of`."""
    words = _plain_words(text)
    numbers = [b for a, b in zip(words, words[1:]) if a in _BEFORE_VERSION and re.match(_VERSION, b)] + [w[1:] for w in words if re.match(_V_VERSION, w)]
    return sorted({re.sub(r"([.]0)+$", "", n) for n in numbers} | {p for w in words for p in w.split("-") if p in _QUALIFIERS})


def least_common(size: int, threshold: Fraction = THRESHOLD) -> int:
    """Bigrams that any matching unit shares with a template of this size."""
    share = threshold / (2 - threshold) * size
    return -(-share.numerator // share.denominator)


def covering_words(templates=TEMPLATES, threshold: Fraction = THRESHOLD) -> list[str]:
    """Words of which a unit must hold at least one to match any template: the word that helps most
    templates first, until every template's bigrams without a chosen word are too few."""
    left = [_plain_bigrams(t) for _, t in templates]
    needed = [least_common(len(b), threshold) for b in left]
    chosen: list[str] = []
    while any(len(b) >= n for b, n in zip(left, needed)):
        votes: Counter = Counter()
        for b, n in zip(left, needed):
            if len(b) >= n:
                for word in {w for g in b for w in g.split()}:
                    votes[word] += min(len(b) - n + 1, sum(word in g.split() for g in b)) * (len(word) >= 6) * 1000 + len(word)
        word = max(sorted(votes), key=votes.get)
        chosen.append(word)
        left = [[g for g in b if word not in g.split()] for b in left]
    return chosen


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def words_of_unit(unit: Column) -> Column:
    spaced = F.regexp_replace(F.lower(unit), _DROPPED, " ")
    return F.filter(F.transform(F.split(spaced, " ", -1), lambda w: F.rtrim(w, F.lit("."))), lambda w: w != "")


def bigrams(unit: Column) -> Column:
    pairs = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return _let(words_of_unit(unit), lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(pairs(w)))


def marks_of(w: Column) -> Column:
    """The versions (a closing .0 aside) and the qualifiers among a unit's words, sorted."""
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(a.isin(*_BEFORE_VERSION) & b.rlike(_VERSION), b))
    named = F.transform(F.filter(w, lambda x: x.rlike(_V_VERSION)), lambda x: F.substr(x, F.lit(2)))
    numbers = F.transform(F.concat(F.array_compact(pairs), named), lambda x: F.regexp_replace(x, "([.]0)+$", ""))
    return F.array_sort(F.array_distinct(F.concat(numbers, F.array_intersect(F.flatten(F.transform(w, lambda x: F.split(x, "-"))), F.array(*map(F.lit, _QUALIFIERS))))))


def matches(text: Column, templates=TEMPLATES, threshold: Fraction = THRESHOLD) -> Column:
    """array<struct<unit, license, dice>>: the licences of the best template of every unit that matches one."""
    up, down = threshold.numerator, threshold.denominator
    sized = [(name, _plain_bigrams(t), _plain_marks(t)) for name, t in templates]
    strings = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    known = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(len(b)).alias("size"), strings(b).alias("bigrams"), strings(m).alias("marks")) for name, b, m in sized))
    denials = strings(_NEGATED)
    low, high = min(len(b) for _, b, _ in sized), max(len(b) for _, b, _ in sized)
    wanted = covering_words(templates, threshold)

    def maybe(unit: Column) -> Column:
        lowered, out = F.lower(unit), None
        for word in wanted:
            out = lowered.contains(word) if out is None else out | lowered.contains(word)
        return out

    def best(unit: Column) -> Column:
        def scored(own: Column) -> Column:
            def of(marks: Column) -> Column:
                fit = F.filter(known, lambda t: (t["size"] * (2 * down - up) >= F.size(own) * up) & (F.size(own) * (2 * down - up) >= t["size"] * up) & (t["marks"] == marks))
                return F.transform(fit, lambda t: F.struct((2.0 * F.size(F.array_intersect(own, t["bigrams"])) / (F.size(own) + t["size"])).alias("dice"), t["license"].alias("license")))

            sized = (F.size(own) * (2 * down - up) >= low * up) & (F.size(own) * up <= high * (2 * down - up))
            return F.when(sized & ~F.arrays_overlap(own, denials), _let(_let(words_of_unit(unit), marks_of), of))

        def top(dice: Column) -> Column:
            most = F.array_max(dice)["dice"]
            names = F.array_sort(F.array_distinct(F.transform(F.filter(dice, lambda d: d["dice"] == most), lambda d: d["license"])))
            return F.struct(unit.alias("unit"), names.alias("names"), most.alias("dice"))

        return _let(_let(bigrams(unit), scored), top)

    def settled(kept: Column) -> Column:
        sure = F.transform(F.filter(kept, lambda m: F.size(m["names"]) == 1), lambda m: m["names"][0])

        def of(m: Column) -> Column:
            both = F.array_intersect(m["names"], sure)
            names = F.when((F.size(m["names"]) > 1) & (F.size(both) > 0), both).otherwise(m["names"])
            return F.struct(m["unit"].alias("unit"), F.array_join(names, " or ").alias("license"), m["dice"].alias("dice"))

        return F.transform(kept, of)

    units = F.array_distinct(F.concat(F.split(text, "\n", -1), F.split(text, "\n[ \t\r]*\n", -1), F.array(text)))
    found = F.transform(F.filter(units, maybe), best)
    kept = _let(F.filter(found, lambda m: m["dice"] >= float(threshold)), settled)
    lowered = F.lower(text)
    suspect = None
    for word in wanted:
        suspect = lowered.contains(word) if suspect is None else suspect | lowered.contains(word)
    return F.when(suspect, kept).otherwise(F.array().cast("array<struct<unit:string,license:string,dice:double>>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and matches of every row."""
    return docs.select("doc_id", matches(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("matches"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_matches (units that match a template), licenses (their names, comma-joined) and best_dice."""
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0))
    return rows.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.round(best, 6).alias("best_dice"))


def _oracle() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    listed_words = lambda words: "[" + ", ".join(map(text, words)) + "]"
    listed = ", ".join(f"({i}, {text(name)}, [{', '.join(map(text, _plain_bigrams(t)))}], [{', '.join(map(text, _plain_marks(t)))}]::VARCHAR[])" for i, (name, t) in enumerate(TEMPLATES))
    return rf"""
WITH templates(k, license, grams, marks) AS (VALUES {listed}),
units AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\n[ \t\r]*\n'), [text])) AS unit FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, unit, list_filter(list_transform(string_split(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}.+-]+', ' ', 'g'), ' '), lambda x: rtrim(x, '.')), lambda x: x <> '') AS w FROM units),
grams AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g,
  list_sort(list_distinct(list_concat(list_transform(list_concat(list_transform(list_filter(range(2, len(w) + 1), lambda i: list_contains({listed_words(_BEFORE_VERSION)}, w[i - 1]) AND regexp_matches(w[i], '{_VERSION}')), lambda i: w[i]), list_transform(list_filter(w, lambda x: regexp_matches(x, '{_V_VERSION}')), lambda x: x[2:])), lambda x: regexp_replace(x, '([.]0)+$', '')),
    list_intersect(flatten(list_transform(w, lambda x: string_split(x, '-'))), {listed_words(_QUALIFIERS)})))) AS marks FROM words WHERE len(w) >= 2),
scored AS (SELECT doc_id, unit, license, 2.0 * len(list_intersect(g, t.grams)) / (len(g) + len(t.grams)) AS dice FROM grams, templates t WHERE t.marks = grams.marks AND NOT list_has_any(g, {listed_words(_NEGATED)}) AND len(g) * 1.5 >= len(t.grams) AND len(t.grams) * 1.5 >= len(g)),
best AS (SELECT doc_id, unit, list_sort(list_distinct(list(license))) AS names, max(dice) AS dice FROM (SELECT * FROM scored WHERE dice >= 0.8 QUALIFY dice = max(dice) OVER (PARTITION BY doc_id, unit)) GROUP BY doc_id, unit),
decided AS (SELECT doc_id, list_distinct(list(names[1])) AS sure FROM best WHERE len(names) = 1 GROUP BY doc_id),
settled AS (SELECT doc_id, array_to_string(CASE WHEN len(names) > 1 AND len(list_intersect(names, sure)) > 0 THEN list_sort(list_intersect(names, sure)) ELSE names END, ' or ') AS license, dice FROM best LEFT JOIN decided USING (doc_id)),
per AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS top FROM settled GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, round(coalesce(top, 0)::DOUBLE, 6) AS best_dice FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
"""


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLES = {"op5_license_scan": _oracle()}
