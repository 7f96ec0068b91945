"""Licence statements: windows of a text against licence templates, by the Dice coefficient of word bigrams.

A window is a run of as many words as the template has, wherever it stands, so a statement is found on a line of its
own, inside a longer line and across lines. A window that reaches the threshold must share so many bigrams with the
template that it holds one of the template's few rarest ones (anchors); only windows around anchors are compared, and
only templates of a size that can reach the threshold. Licences of one family are told apart by words that a window
must have or must not have. All steps are column expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import cache
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_ADS = "All advertising materials mentioning features or use of this software must display the following acknowledgement:"
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
_GNU = "{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons Attribution{more} 4.0 International License."

#: Short forms, notices and texts of public licences; words a window must have, words it must not have.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache", ""),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "apache", ""),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "", ""),
    ("MIT", "Released under the MIT License.", "mit", ""),
    ("MIT", "Licensed under the MIT License.", "mit", ""),
    ("MIT", _MIT, "sublicense", ""),
    ("MIT", f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}", "sublicense", ""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu 3", "lesser affero library"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu 2", "lesser affero library"),
    ("GPL-3.0-or-later", _GNU.format(what="This program", kind="", version="3"), "gnu 3", "lesser affero library"),
    ("GPL-2.0-or-later", _GNU.format(what="This program", kind="", version="2"), "gnu 2", "lesser affero library"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3.", "lesser 3", "affero"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1.", "lesser 2 1", "affero"),
    ("LGPL-3.0-or-later", _GNU.format(what="This library", kind="Lesser ", version="3"), "lesser 3", "affero"),
    ("LGPL-2.1-or-later", _GNU.format(what="This library", kind="Lesser ", version="2.1"), "lesser 2 1", "affero"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3.", "affero 3", "lesser"),
    ("AGPL-3.0-or-later", _GNU.format(what="This program", kind="Affero ", version="3"), "affero 3", "lesser"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4", "nc sa nd"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4", "sa nd"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4", "nc nd"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", "cc by nd 4", "nc sa"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa 4", "nd"),
    ("CC-BY-4.0", _CC.format(more=""), "creative 4", "noncommercial sharealike noderivatives"),
    ("CC-BY-NC-4.0", _CC.format(more="-NonCommercial"), "creative noncommercial 4", "sharealike noderivatives"),
    ("CC-BY-SA-4.0", _CC.format(more="-ShareAlike"), "creative sharealike 4", "noncommercial noderivatives"),
    ("CC-BY-NC-SA-4.0", _CC.format(more="-NonCommercial-ShareAlike"), "creative noncommercial sharealike 4", "noderivatives"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "waived", ""),
    ("BSD", _BSD, "redistribution", ""),
    ("BSD-2-Clause", f"{_BSD} 1. {_BSD_1} 2. {_BSD_2} {_BSD_END}", "redistributions", "neither advertising"),
    ("BSD-3-Clause", f"{_BSD} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_NAME} {_BSD_END}", "redistributions neither", "advertising"),
    ("BSD-3-Clause", _BSD_NAME, "neither endorse", "advertising"),
    ("BSD-4-Clause", f"{_BSD} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_ADS} This product includes software developed by the organization. 4. {_BSD_NAME} {_BSD_END}", "redistributions neither advertising", ""),
    ("BSD-4-Clause", _BSD_ADS, "advertising acknowledgement", ""),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.", "hereby appear", ""),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}", "hereby appear disclaims", ""),
    ("0BSD", f"{_ISC}. {_ISC_END}", "hereby disclaims", "appear"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla", ""),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered", ""),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "alter freely", ""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "boost", ""),
)


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def grams_of(words: list[str]) -> list[str]:
    """Distinct pairs of neighbours, in order of first occurrence."""
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


@cache
def anchors(percent: int) -> dict[str, list[int]]:
    """Bigram -> templates of which it is an anchor.

    A window that reaches the threshold shares at least percent / (200 - percent) of a template's bigrams, so it misses
    fewer than the rest and one: that many of its bigrams are anchors, the longest ones, as they are the rarest in prose,
    and those of more than eight templates last.
    """
    own = [grams_of(words_of(body)) for _, body, _, _ in TEMPLATES]
    common = Counter(g for gs in own for g in gs)
    out: dict[str, list[int]] = {}
    for k, gs in enumerate(own):
        least = ceil(percent * len(gs) / (200 - percent))
        for g in sorted(gs, key=lambda g: (common[g] > 8, -len(g), g))[: len(gs) - least + 1]:
            out.setdefault(g, []).append(k)
    return out


def _words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    flat = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once a row; a column named in a lambda is computed anew for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pairs(words: Column) -> Column:
    pair = lambda w, i: F.concat(F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1))
    return _once(words, lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: pair(w, i))).otherwise(F.array().cast("array<string>")))


def _map(table: dict) -> Column:
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), v)))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def statements(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, begin (word number), template, license, size (of the template), dice of every window that matches.

    A window (as many words as the template, from any word on, cut off at the end of the text) matches if
    100 * 2 * shared >= percent * (window + template) over distinct bigrams of lower-cased ASCII words, it has all words
    that the template must have and none that it must not have.

    Null texts and texts of less than two words match nothing. Rows are searched each alone: null or repeated ids don't
    matter. Other columns are not read. An empty table gives no rows.
    """
    lengths = [len(words_of(body)) for _, body, _, _ in TEMPLATES]
    by_gram = anchors(percent)
    # a window of a template that holds the anchor begins at most its length before the anchor ends
    which = _map({g: F.array(*(F.struct(F.lit(k).alias("template"), F.lit(lengths[k]).alias("length")) for k in ks)) for g, ks in by_gram.items()})
    begins = lambda h, t: F.transform(F.sequence(F.greatest(F.lit(0), h["at"] - t["length"] + 2), h["at"]), lambda b: F.struct(t["template"].alias("template"), t["length"].alias("length"), b.alias("begin")))
    around = lambda h: F.flatten(F.transform(which[h["gram"]], lambda t: begins(h, t)))
    hits = lambda w: F.filter(F.transform(_pairs(w), lambda g, i: F.struct(g.alias("gram"), i.alias("at"))), lambda h: h["gram"].isin(list(by_gram)))
    cut = lambda w, f: F.struct(f["template"].alias("template"), f["begin"].alias("begin"), F.slice(w, f["begin"] + 1, f["length"]).alias("own"))
    within = lambda w: F.transform(F.array_distinct(F.flatten(F.transform(hits(w), around))), lambda f: cut(w, f))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(_once(_words(F.col(text_col).cast("string")), within)).alias("w"))
    windows = rows.select("doc_id", "w.template", "w.begin", "w.own")
    known = {k: (name, grams_of(words_of(body)), must.split(), never.split()) for k, (name, body, must, never) in enumerate(TEMPLATES)}
    table = _map({k: F.struct(F.lit(n).alias("license"), _strings(g).alias("grams"), _strings(m).alias("must"), _strings(v).alias("never")) for k, (n, g, m, v) in known.items()})
    windows = windows.withColumn("known", table[F.col("template")])
    windows = windows.filter((F.size(F.array_except("known.must", "own")) == 0) & ~F.arrays_overlap("known.never", "own"))
    size = F.size("known.grams")
    counted = _once(F.array_distinct(_pairs(F.col("own"))), lambda g: F.struct(F.size(g).alias("n"), F.when(((200 - percent) * F.size(g) >= percent * size) & (percent * F.size(g) <= (200 - percent) * size), F.size(F.array_intersect(g, F.col("known.grams")))).otherwise(0).alias("shared")))
    out = windows.select("doc_id", "begin", "template", F.col("known.license").alias("license"), size.alias("size"), counted.alias("c")).select("*", "c.n", "c.shared")
    out = out.filter(200 * F.col("shared") >= percent * (F.col("n") + F.col("size")))
    return out.select("doc_id", "begin", "template", "license", "size", (2 * F.col("shared") / (F.col("n") + F.col("size"))).alias("dice"))


def scan(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that holds a licence statement: doc_id, license, dice, licenses.

    license and dice are those of the best match of `statements`: the highest coefficient, then the larger template, then
    the smallest name. licenses has the names of all matches, sorted, comma-joined. Rows that repeat an id count as one
    document; a null id is an id of its own. Everything else as in `statements`.
    """
    best = F.min(F.struct((-F.col("dice")).alias("dice"), (-F.col("size")).alias("size"), "license")).alias("best")
    names = F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses")  # as many as there are templates at most
    out = statements(docs, percent, id_col, text_col).groupBy("doc_id").agg(best, names)
    return out.select("doc_id", F.col("best.license").alias("license"), (-F.col("best.dice")).alias("dice"), "licenses")
