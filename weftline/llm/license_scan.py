"""License scan: normalised passages against licence templates by Dice coefficient over word
bigrams, in DataFrame functions only.

A passage is a line of a text, a block of lines between blank lines, or the whole text where it
has several blocks. Passages and templates are lower-cased words of letters and digits. Dice is
taken over bigrams with their multiplicity, so a passage of n words has n - 1 of them.

Pruning, all exact for a Dice of ``min_dice`` or more: a template of b bigrams only matches
passages of between b * t / (2 - t) and b * (2 - t) / t bigrams; and such a passage shares
at least one of the template's rarest b - ceil(b * t / (2 - t)) + 1 bigrams (by bigram, not
position), which is looked up by a broadcast join on that fixed list, after a test for the
rarer words of those bigrams: of the whole text before it is cut, then of each passage. Only the few passages that
meet a template that way are compared in full, inside their row; nothing but those is shuffled.

Defined results: null or empty text has no passages; equal scores go to the first template by
name; rows that repeat an id or have a null one give matches each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import any_of, text_column
from weftline.llm.host_quality import let

# The wording of public licences and of the notices that name them.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
        "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS "
        "PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-2-Clause-notice": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name "
        "of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
        "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the "
        "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to "
        "do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above "
        "license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in "
        "part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
        "machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE "
        "FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have "
        "received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, "
        "Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" "
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
        "version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT-licensed-notice": "Licensed under the MIT License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
        "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, version 2.0.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
        "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
        "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
        "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The "
        "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered "
        "source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice "
        "may not be removed or altered from any source distribution."
    ),
}

# Frequent English words, which make a bigram a poor key.
FREQUENT = frozenset("a all an and any as at be being but by for from in is it may must no not of on or other so such that the this to was way will with you your".split())


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def size_bounds(bigrams: int, min_dice: float) -> tuple[int, int]:
    """Fewest and most bigrams of a passage that can reach ``min_dice``."""
    return math.ceil(bigrams * min_dice / (2 - min_dice) - 1e-9), math.floor(bigrams * (2 - min_dice) / min_dice + 1e-9)


def rarity(word: str) -> int:
    """Longer words are rarer; frequent ones and numbers come last."""
    return 0 if word in FREQUENT or word.isdigit() else len(word)


def sign_of(bigram: str) -> str:
    """The rarer word of a bigram."""
    return max(bigram.split(), key=lambda w: (rarity(w), len(w), w))


def template_rows(templates: dict[str, str], min_dice: float) -> list[tuple]:
    """``(license, size, least, most, bigram kinds, their counts, keys)`` of each template."""
    rows = []
    for name, text in sorted(templates.items()):
        words = words_of(text)
        counts = Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
        size = sum(counts.values())
        least, most = size_bounds(size, min_dice)
        # A passage that has none of the key bigrams shares at most the others' occurrences,
        # and these are fewer than the least overlap any match needs.
        rare = sorted(counts, key=lambda b: (-rarity(sign_of(b)), sum(w in FREQUENT or w.isdigit() for w in b.split()), -len(b), b))
        others, keys = size, []
        for b in rare:
            if others < least:
                break
            keys.append(b)
            others -= counts[b]
        kinds = sorted(counts)
        rows.append((name, size, least, most, kinds, [counts[b] for b in kinds], keys))
    return rows


def holds(text: Column, word: str) -> Column:
    """Whether a text may hold a word; short ones, which many words contain, only by themselves."""
    found = F.contains(text, F.lit(word))
    return found if len(word) > 3 else found & F.rlike(text, F.lit(rf"(?<![\p{{L}}\p{{N}}]){word}(?![\p{{L}}\p{{N}}])"))


def bigrams(passage: Column) -> Column:
    """Bigrams of a normalised passage, which is split once and not for each word."""
    return let(F.split(passage, " "), _bigrams)


def _bigrams(words: Column) -> Column:
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))


def passages(docs: DataFrame, least: int, most: int) -> DataFrame:
    """``doc_id, kind, place, row, passage`` of the passages with a number of bigrams in reach;
    ``row`` tells the table's rows apart, whatever their ids."""
    text = text_column(docs)
    # Each list is bound once by ``let``: a plain alias may be copied into what uses it.
    plain = F.transform(F.split(F.lower(text), "\n", -1), lambda x: F.btrim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")))
    def unit(kind: str, place: Column, x: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), place.cast("long").alias("place"), x.alias("passage"))

    def found(lines: Column, blocks: Column) -> Column:
        return F.concat(
            F.transform(lines, lambda x, i: unit("line", i, x)),
            F.filter(F.transform(blocks, lambda x, i: unit("block", i, x)), lambda u: u["passage"].contains("\n")),
            F.when(F.size(blocks) > 1, F.array(unit("text", F.lit(0), F.array_join(blocks, "\n"))))
            .otherwise(F.array().cast("array<struct<kind:string,place:bigint,passage:string>>")),
        )

    def both(lines: Column) -> Column:
        return let(F.split(F.btrim(F.array_join(lines, "\n"), F.lit("\n")), "\n\n+"), lambda blocks: found(lines, blocks))

    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_row").alias("row"), F.explode(let(plain, both)).alias("u"))
    units = units.select("doc_id", "row", "u.kind", "u.place", F.translate("u.passage", "\n", " ").alias("passage"))
    size = F.length("passage") - F.length(F.replace("passage", F.lit(" "), F.lit("")))
    return units.withColumn("size", size).where(F.col("size").between(least, most))


def license_scan(docs: DataFrame, min_dice: float = 0.8, templates: dict[str, str] | None = None) -> DataFrame:
    """Passages that match a template: ``doc_id, kind, place, license, dice``, the best licence
    of each."""
    spark: SparkSession = docs.sparkSession
    rows = template_rows(templates or TEMPLATES, min_dice)
    known = spark.createDataFrame(
        rows, "license string, b int, least int, most int, kinds array<string>, counts array<int>, keys array<string>"
    )
    # A key bigram brings its rarer word along: most texts and passages have none of those and
    # end here, texts before they are cut.
    signs = sorted({sign_of(key) for r in rows for key in r[6]})
    low = F.lower(text_column(docs))
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"), let(low, lambda x: any_of([holds(x, s) for s in signs])).alias("_signed"))
    units = passages(numbered.where("_signed"), min(r[2] for r in rows), max(r[3] for r in rows))
    units = units.where(F.arrays_overlap(F.split("passage", " "), F.array(*map(F.lit, signs))))
    units = units.withColumn("_grams", bigrams(F.col("passage")))
    keyed = F.broadcast(known.select("license", "least", "most", F.explode("keys").alias("key")))  # a fixed list
    met = units.select("doc_id", "row", "kind", "place", "passage", "size", F.explode(F.array_distinct("_grams")).alias("key")).join(keyed, "key")
    met = met.where(F.col("size").between(F.col("least"), F.col("most")))
    met = met.select("doc_id", "row", "kind", "place", "passage", "size", "license").distinct()
    pairs = met.join(F.broadcast(known.select("license", "b", "kinds", "counts")), "license")
    pairs = pairs.withColumn("_grams", bigrams(F.col("passage")))
    shared = F.aggregate(
        let(F.col("_grams"), lambda grams: F.zip_with("kinds", "counts", lambda k, n: F.least(n, F.size(F.filter(grams, lambda g: g == k))))),
        F.lit(0),
        lambda a, x: a + x,
    )
    scored = pairs.select("doc_id", "row", "kind", "place", "license", (2.0 * shared / (F.col("size") + F.col("b"))).alias("dice"))
    best = scored.where(F.col("dice") >= min_dice).groupBy("doc_id", "row", "kind", "place").agg(
        F.min(F.struct((-F.col("dice")).alias("less"), "license")).alias("top")
    )
    return best.select("doc_id", "kind", "place", F.col("top.license").alias("license"), (-F.col("top.less")).alias("dice"))


def oracle(min_dice: float = 0.8) -> str:
    """The same scan without keys, for DuckDB: every passage against every template in reach."""
    values = ", ".join("('{}', '{}')".format(n, " ".join(words_of(t))) for n, t in sorted(TEMPLATES.items()))
    return rf"""
WITH t(license, words) AS (VALUES {values}),
tw AS (SELECT license, string_split(words, ' ') AS w FROM t),
tb AS (SELECT license, len(w) - 1 AS b, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM tw),
tg AS (SELECT license, gram, count(*) AS n FROM (SELECT license, unnest(g) AS gram FROM tb) GROUP BY ALL),
d AS (SELECT doc_id, row_number() OVER () AS r, list_transform(string_split(lower(coalesce(text, '')), chr(10)),
             lambda x: trim(regexp_replace(x, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) AS lines FROM documents),
e AS (SELECT doc_id, r, lines, string_split_regex(trim(array_to_string(lines, chr(10)), chr(10)), '\n\n+') AS blocks FROM d),
u AS (
  SELECT doc_id, r, 'line' AS kind, unnest(range(0, len(lines))) AS place, unnest(lines) AS passage FROM e
  UNION ALL SELECT doc_id, r, 'block', unnest(range(0, len(blocks))), unnest(blocks) FROM e
  UNION ALL SELECT doc_id, r, 'text', 0, array_to_string(blocks, chr(10)) FROM e WHERE len(blocks) > 1),
v AS (SELECT doc_id, r, kind, place, string_split(replace(passage, chr(10), ' '), ' ') AS w FROM u
      WHERE kind <> 'block' OR contains(passage, chr(10))),
s AS (SELECT doc_id, r, kind, place, len(w) - 1 AS size, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g
      FROM v WHERE len(w) - 1 <= (SELECT max(b) * {2 - min_dice} / {min_dice} FROM tb)),
sg AS (SELECT doc_id, r, kind, place, size, gram, count(*) AS n FROM (SELECT doc_id, r, kind, place, size, unnest(g) AS gram FROM s) GROUP BY ALL),
p AS (SELECT doc_id, r, kind, place, license, 2.0 * sum(least(sg.n, tg.n)) / (any_value(size) + any_value(b)) AS dice
      FROM sg JOIN tg USING (gram) JOIN tb USING (license) GROUP BY doc_id, r, kind, place, license)
SELECT doc_id, kind, place::BIGINT AS place, license, dice::DOUBLE AS dice FROM p WHERE dice >= {min_dice}
QUALIFY row_number() OVER (PARTITION BY r, kind, place ORDER BY dice DESC, license) = 1
"""
