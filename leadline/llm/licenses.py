"""Licence scan: passages against licence templates by Dice coefficient over word bigrams (operator 4, native).

A document's units are its lines, its paragraphs of several lines and, if it has several paragraphs, the whole
text. A unit's normalised words (A-Z lower-cased; anything ASCII but letters and digits parts words) give a
set of word bigrams, compared with every template's: 2 |A & B| / (|A| + |B|). Only templates whose size allows
`threshold` are compared, |B| t / (2 - t) <= |A| <= |B| (2 - t) / t, and only units with an anchor word: the
anchors are chosen so that a unit without any of them lacks more bigrams of each template than a match may.

Passages lie anywhere in the words of the text, across lines and paragraphs or inside a longer line. A window's
Dice coefficient never falls when it grows over neighbouring bigrams of the template, so windows from the start of
a run of such bigrams to the end of a run suffice, of at most `SPAN` times as many bigrams as the template has. Of
overlapping windows the nearest to a template stays, then of overlapping passages the one that shares most bigrams
with its template; a passage is left out where a matching unit that shares as many overlaps it.

All is done with column functions inside the row: one pass, no shuffle, nothing grows but with the text. The
templates are a parameter (at most `MOST` of them, a literal in the plan).

Defined results: null and empty texts, and units of one word, match nothing; of templates that are equally
near the first by name counts; repeated rows are scanned alike; texts are read whole; an empty table gives an empty
result; a column of the output's name is replaced, all others are kept whatever their names; ids of rows aren't read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 500
SPAN = 3
#: Words that any text may hold: they are anchors only where a template has no others.
COMMON = frozenset("a an and any are as at be by for from in is it its no not of on or that the this to was with you".split())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII but letters, digits and the line feed.
PARTS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
CC = {"BY": "by", "BY-SA": "by sa", "BY-ND": "by nd", "BY-NC": "by nc", "BY-NC-SA": "by nc sa", "BY-NC-ND": "by nc nd"}
GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'

BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC_WARRANTY = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

#: Public texts in full: permissive licences, and the notice that goes with a file under a GNU licence.
TEXTS = {
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    + 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. '
    + 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "PostgreSQL": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
}
GNU_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details. You should have received a copy of the {} along with this program. If not, see <https://www.gnu.org/licenses/>."


def templates() -> list[tuple[str, str]]:
    """(licence, text): public notices in common wordings."""
    out = [
        ("MIT", "Released under the MIT License."),
        ("MIT", "Licensed under the MIT License."),
        ("MIT", "This project is licensed under the terms of the MIT license."),
        ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + WARRANTY),
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
        ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
        ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
        ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
        ("BSD-3-Clause", BSD + BSD_3 + BSD_WARRANTY),
        ("BSD-2-Clause", BSD + BSD_WARRANTY),
        ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
        ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." + ISC_WARRANTY),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
        ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
        ("Unlicense", "This is free and unencumbered software released into the public domain."),
        ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
        ("Proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
    ]
    for name, words in CC.items():
        out += [(f"CC-{name}-4.0", f"Licensed under CC {words} 4.0."), (f"CC-{name}-4.0", f"This work is licensed under CC {words} 4.0.")]
    for name, words in GNU.items():
        for version in (("2", "3") if name == "GPL" else ("3",)):
            out += [(f"{name}-{version}.0", f"{'This work is licensed' if s else 'Licensed'} under the {words}, version {version}.") for s in (0, 1)]
            out.append((f"{name}-{version}.0", f"This program is free software: you can redistribute it and/or modify it under the terms of the {words} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."))
            out.append((f"{name}-{version}.0", out[-1][1] + " " + GNU_REST.format(words, words)))
    return out + list(TEXTS.items())


def bigrams(text: str) -> set[str]:
    """A template's set, as unit_bigrams() makes it."""
    words = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split(" ")
    words = [w for w in words if w]
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def anchors(sets: list[set[str]], threshold: float) -> list[str]:
    """Words of which every match of a template holds one: of each set the longest words, common ones last, until they touch more bigrams than a match may lack."""
    out: set[str] = set()
    for s in sets:
        words = sorted({w for b in s for w in b.split(" ")}, key=lambda w: (w in COMMON, w not in out, -len(w), w))
        held: set[str] = set()
        for w in words:
            if sum(1 for b in s if held & set(b.split(" "))) > len(s) * (1 - threshold / (2 - threshold)) + 1e-9:
                break
            held.add(w)
        out |= held
    return sorted(out)


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, text: str = "text", threshold: float = 0.8, out: str = "licenses") -> DataFrame:
    """docs with array<struct<license,unit,no,dice>>: each matching unit ('line', 'paragraph' or 'text', numbered from 0) with its nearest template, then each 'passage' with the number of its first word; a column of that name is replaced."""
    known = templates() if known is None else known
    sets = [(name, bigrams(t)) for name, t in sorted(known)]
    sets = [(name, s) for name, s in sets if s]
    if len(sets) > MOST or not 0 < threshold <= 1:
        raise ValueError(f"at most {MOST} templates and a threshold in (0, 1]")
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out]
    none = "cast(array() as array<struct<license:string,unit:string,no:int,dice:double>>)"
    if not sets:
        return docs.select(*kept, F.expr(none).alias(out))
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    listed = lambda xs: "array(" + ", ".join(quoted(x) for x in xs) + ")"
    table = F.expr("array(" + ", ".join(f"named_struct('license', {quoted(n)}, 'size', {len(s)}, 'set', {listed(sorted(s))})" for n, s in sets) + ")")
    known_bigrams = F.expr(listed(sorted(set().union(*(s for _, s in sets)))))
    least = threshold / (2 - threshold)
    anchor = F.expr(listed(anchors([s for _, s in sets], threshold)))
    norm = F.regexp_replace(F.translate(F.col(f"`{text}`"), UPPER, LOWER), PARTS, " ")
    words = lambda x: F.filter(F.split(x, "[ \n]+"), lambda w: w != "")

    def numbered(units, kind: str):
        return F.transform(units, lambda u, i: F.struct(F.lit(kind).alias("unit"), i.cast("int").alias("no"), u.alias("text")))

    paragraphs = F.split(norm, "\n *\n[ \n]*")
    several = F.filter(numbered(paragraphs, "paragraph"), lambda u: F.instr(u["text"], "\n") > 0)
    whole = F.when(F.size(paragraphs) > 1, numbered(F.array(norm), "text")).otherwise(F.array_except(numbered(F.array(norm), "text"), numbered(F.array(norm), "text")))
    units = F.concat(numbered(F.split(norm, "\n"), "line"), several, whole)

    def pairs_of(ws):
        return F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws) - 1), lambda a, b: F.concat(a, F.lit(" "), b))

    def unit_bigrams(ws):
        return F.array_distinct(pairs_of(ws))

    def nearest(u):
        """The template of greatest Dice coefficient among those whose size allows a match."""
        near = F.filter(table, lambda t: (u["n"] >= t["size"] * least - 1e-9) & (u["n"] <= t["size"] / least + 1e-9))
        rated = F.transform(near, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(u["set"], t["set"])) / (u["n"] + t["size"])).alias("dice"), t["license"].alias("license"), t["size"].alias("size")))
        start = F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("license"), F.lit(0).alias("size"))
        return F.aggregate(rated, start, lambda a, t: F.when(t["dice"] > a["dice"], t).otherwise(a))

    def bound(x, f):
        """f(x), with x worked out once."""
        return F.element_at(F.transform(F.array(x), f), 1)

    def apart(sorted_):
        """The first of each group that overlaps."""
        over = lambda acc, x: F.exists(acc, lambda y: (y["from"] <= x["to"]) & (x["from"] <= y["to"]))
        return F.aggregate(sorted_, F.filter(sorted_, lambda x: F.lit(False)), lambda acc, x: F.when(over(acc, x), acc).otherwise(F.concat(acc, F.array(x))))

    def windows(pairs, t):
        """The windows of `pairs` that match t, the nearest of those that overlap."""
        hits = F.filter(F.transform(pairs, lambda b, p: F.when(F.array_contains(t["set"], b), p)), lambda p: p.isNotNull())

        def matching(hits):
            edge = lambda step: F.filter(F.transform(hits, lambda p, k: F.struct(p.alias("p"), k.alias("k"))), lambda x: F.coalesce(F.get(hits, x["k"] + step) != x["p"] + step, F.lit(True)))
            far = lambda s, e: (e["k"] - s["k"] + 1 >= t["size"] * least - 1e-9) & (e["p"] - s["p"] < t["size"] * SPAN)

            def rated(s, e):
                part = F.slice(pairs, s["p"] + 1, e["p"] - s["p"] + 1)
                return bound(F.size(F.array_intersect(part, t["set"])), lambda c: F.struct((F.lit(-2.0) * c / (F.size(F.array_distinct(part)) + t["size"])).alias("far"), s["p"].alias("from"), e["p"].alias("to"), c.alias("common")))

            every = bound(edge(1), lambda ends: F.flatten(F.transform(edge(-1), lambda s, r: F.transform(F.filter(F.slice(ends, r + 1, t["size"] * SPAN), lambda e: far(s, e)), lambda e: rated(s, e)))))
            return bound(F.array_sort(F.filter(every, lambda w: w["far"] <= -threshold + 1e-9)), apart)

        return bound(hits, matching)

    def passages(ws, units):
        """Matches anywhere among the words, but where one of `units` shares as many bigrams."""

        def among(pairs):
            able = bound(F.array_intersect(pairs, known_bigrams), lambda seen: F.filter(table, lambda t: F.size(F.array_intersect(seen, t["set"])) >= t["size"] * least - 1e-9))
            every = F.flatten(F.transform(able, lambda t: F.transform(windows(pairs, t), lambda w: F.struct((-w["common"]).alias("lack"), w["far"].alias("far"), t["license"].alias("license"), w["from"].alias("from"), w["to"].alias("to")))))
            return bound(F.array_sort(every), apart)

        held = lambda w: F.exists(units, lambda u: (u["common"] >= -w["lack"]) & (u["from"] <= w["to"]) & (w["from"] < u["to"]))
        new = F.filter(bound(pairs_of(ws), among), lambda w: ~held(w))
        return F.transform(F.array_sort(F.transform(new, lambda w: F.struct(w["from"], w["license"], w["far"]))), lambda w: F.struct(w["license"].alias("license"), F.lit("passage").alias("unit"), w["from"].cast("int").alias("no"), (-w["far"]).alias("dice")))

    def placed(u):
        """A matching unit with its first word and the one after its last."""
        same = F.when(u["unit"] == "line", F.split(norm, "\n")).otherwise(paragraphs)
        before = F.when(u["unit"] == "text", F.lit(0)).otherwise(F.aggregate(F.slice(same, 1, u["no"]), F.lit(0), lambda a, x: a + F.size(words(x))))
        return bound(before, lambda b: F.struct(u["common"].alias("common"), b.alias("from"), (b + F.when(u["unit"] == "text", F.size(words(norm))).otherwise(F.size(words(F.get(same, u["no"]))))).alias("to")))

    marked = F.filter(units, lambda u: F.arrays_overlap(F.split(u["text"], "[ \n]+"), anchor))
    split = F.filter(F.transform(marked, lambda u: F.struct(u["unit"], u["no"], words(u["text"]).alias("ws"))), lambda u: F.size(u["ws"]) > 1)
    sized = F.transform(F.transform(split, lambda u: F.struct(u["unit"], u["no"], unit_bigrams(u["ws"]).alias("set"))), lambda u: F.struct(u["unit"], u["no"], u["set"], F.size(u["set"]).alias("n")))
    rated = F.transform(sized, lambda u: F.struct(u["unit"], u["no"], u["n"], nearest(u).alias("x")))
    found = F.transform(F.filter(rated, lambda u: u["x"]["dice"] >= threshold - 1e-9), lambda u: F.struct(u["x"]["license"].alias("license"), u["unit"].alias("unit"), u["no"].alias("no"), u["x"]["dice"].alias("dice"), F.round(u["x"]["dice"] * (u["n"] + u["x"]["size"]) / 2).cast("int").alias("common")))
    plain = lambda us: F.transform(us, lambda u: F.struct(u["license"].alias("license"), u["unit"].alias("unit"), u["no"].alias("no"), u["dice"].alias("dice")))
    every = bound(found, lambda us: F.concat(plain(us), bound(F.transform(us, placed), lambda at: bound(words(norm), lambda ws: F.when(F.size(ws) > 1, passages(ws, at)).otherwise(F.expr(none))))))
    possible = F.coalesce(F.arrays_overlap(F.split(norm, "[ \n]+"), anchor), F.lit(False))
    return docs.select(*kept, F.when(possible, every).otherwise(F.expr(none)).alias(out))
