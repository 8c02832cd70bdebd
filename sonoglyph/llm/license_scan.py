"""Operator 4, license scans (DataFrame functions only): Dice coefficient over word bigrams against licence templates.

Units of a document are the whole of it, each of its lines, and windows of lines for notices that are wrapped: for each
template one from each line on, up to where its words are as many as the template's. A unit's text is normalised (lower
case, everything but letters, digits and dots inside a number is a break), its distinct word bigrams are compared with the
template's. Since the coefficient of sets of sizes a and b is at most ``2 min(a, b) / (a + b)``, a template is only compared
with units whose size lies within bounds; and since a unit must have so many of the template's bigrams, a template is only
a candidate for documents that have as many, which one intersection with all templates' bigrams tells for most.

Intermediate arrays are bound as variables of array functions: as columns, the optimiser would put their expressions
wherever they are used, and compute them anew for each word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sonoglyph.llm.store import table

DICE = 0.9
#: A window of lines has at least this share of its template's words, and up to twice as many lines as words, and 16.
FULL = 0.95
#: Notices and texts of public licences: fixed values, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: What parts words: all but letters, digits, and dots between digits.
BREAK = r"(?:[^\p{L}\p{N}.]|(?<!\p{N})\.|\.(?!\p{N}))+"


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BREAK), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.xxhash64(a, b))


def bigrams(words: Column) -> Column:
    """Hashes of the distinct pairs of words next to each other."""
    return F.when(F.size(words) >= 2, F.array_distinct(_pairs(words))).otherwise(F.expr("array()").cast("array<bigint>"))


def _templates(spark: SparkSession, templates: list[tuple[str, str]]) -> list[tuple[int, str, list[int], int]]:
    """Number, licence, bigrams and number of words of each template; those of fewer than two words can match nothing."""
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(templates)], "i int, license string, text string")
    made = rows.withColumn("words", normal_words(F.col("text"))).select("i", "license", bigrams(F.col("words")).alias("grams"), F.size("words").alias("n"))
    return [(r["i"], r["license"], r["grams"], r["n"]) for r in made.collect() if r["grams"]]


_FOUND = "array<struct<line:int,n_lines:int,license:string,template:int,dice:double>>"


def license_scan(docs: DataFrame, *, templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """(doc_id, line, n_lines, license, template, dice) of each unit of ``docs`` (doc_id, text) and template whose coefficient
    is at least ``dice``; line counts from 1, 0 is the whole document. Of windows that begin one line after the other only
    those count that the neighbours do not match better; the earlier one of equals.

    Null, empty and one-word units match nothing; the whole of a document of one line is its line 1 alone. Repeated rows
    each give their rows, a repeated line one for each time. No rows or no templates, no rows; other columns are not read.
    """
    known = _templates(docs.sparkSession, templates)
    if not known:
        return docs.select("doc_id", F.lit(0).alias("line"), F.lit(0).alias("n_lines"), F.lit("").alias("license"), F.lit(0).alias("template"), F.lit(0.0).alias("dice")).where("false")
    # a unit needs dice / (2 - dice) of a template's bigrams, and has at most the inverse of that times as many
    low, high = dice / (2 - dice), (2 - dice) / dice
    least = min(len(g) for *_, g, _ in known) * low
    every = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("license"), F.array(*(F.lit(x) for x in g)).alias("grams"), F.lit(n).alias("n")) for i, k, g, n in known))
    union = F.array(*(F.lit(x) for x in sorted({x for *_, g, _ in known for x in g})))

    def coefficient(words: Column, t: Column) -> Column:
        """Null for units that are too small or too large."""
        size = F.size(t["grams"])
        grams = F.when(F.size(words) - 1 >= size * low, bigrams(words))
        return let(grams, lambda g: F.when((F.size(g) >= size * low) & (F.size(g) <= size * high), 2 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + size)))

    def matches(line: Column, n: Column, value: Column, t: Column) -> Column:
        return F.struct(line.cast("int").alias("line"), n.cast("int").alias("n_lines"), t["license"].alias("license"), t["i"].alias("template"), value.alias("dice"))

    def windows(lines: Column, t: Column) -> Column:
        """(number of lines, coefficient) of the window that begins at each line."""
        need = t["n"] * FULL

        def one(first: Column, i: Column) -> Column:
            sized = F.aggregate(F.slice(lines, i + 1, 2 * t["n"] + 16), F.struct(F.lit(0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.when(a["s"] >= need, a).otherwise(F.struct((a["s"] + F.size(x)).alias("s"), (a["n"] + 1).alias("n"))))
            apart = lambda a: (F.size(first) > 0) & (a["s"] >= need) & (a["n"] >= 2) & (a["n"] < F.size(lines))
            return let(sized, lambda a: F.struct(a["n"].alias("n"), F.when(apart(a), coefficient(F.flatten(F.slice(lines, i + 1, a["n"])), t)).alias("d")))

        return F.transform(lines, one)

    def units(lines: Column, words: Column, t: Column) -> Column:
        whole = F.array(matches(F.lit(0), F.size(lines), F.when(F.size(lines) > 1, coefficient(words, t)), t))
        single = F.transform(lines, lambda x, i: matches(i + 1, F.lit(1), coefficient(x, t), t))
        value = lambda w, i: F.coalesce(F.get(w, i)["d"], F.lit(0.0))
        best = let(windows(lines, t), lambda w: F.transform(w, lambda x, i: matches(i + 1, x["n"], F.when((x["d"] > value(w, i - 1)) & (x["d"] >= value(w, i + 1)), x["d"]), t)))
        return F.filter(F.concat(whole, single, best), lambda m: m["dice"] >= dice)

    def scan(lines: Column) -> Column:
        return let(F.flatten(lines), lambda words: let(F.when(F.size(words) > least, F.array_intersect(_pairs(words), union)), lambda hits: F.when(F.size(hits) >= least, (
            F.flatten(F.transform(F.filter(every, lambda t: F.size(F.array_intersect(hits, t["grams"])) >= F.size(t["grams"]) * low), lambda t: units(lines, words, t)))))))

    found = let(F.when(F.length("text") >= 2 * least, F.transform(F.split("text", "\n", -1), normal_words)), scan)  # a bigram has two characters and a break
    rows = docs.select("doc_id", F.explode(F.coalesce(found.cast(_FOUND), F.expr("array()").cast(_FOUND))).alias("m"))
    return rows.select("doc_id", "m.line", "m.n_lines", "m.license", "m.template", "m.dice")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line", "n_lines", "license", "template", F.round("dice", 9).alias("dice"))


def _sql(templates: list[tuple[str, str]], dice: float) -> str:
    rows = ", ".join(f"({i}, '{k}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (k, t) in enumerate(templates))
    words = r"list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}.]+', ' ', 'g'), '(^|[^\p{{N}}])\.+', '\1 ', 'g'), '\.+($|[^\p{{N}}])', ' \1', 'g')), ' '), lambda w: w <> '')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    low, high = dice / (2 - dice), (2 - dice) / dice
    value = "2 * len(list_intersect(g, tg)) / (len(g) + len(tg))"
    return f"""
with t as (select i as template, license, {grams} as tg, len(w) as tn from (select i, license, {words.format('x')} as w from (values {rows}) v(i, license, x))),
d as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: {words.format('x')}) as ws from documents where text is not null),
l as (select *, unnest(range(1, len(ws) + 1)) as pos from d),
c as (select doc_id, ws, pos, len(ws[pos]) as n, sum(len(ws[pos])) over (partition by doc_id order by pos) as upto from l),
u as (select doc_id, 0 as line, len(ws) as n_lines, flatten(ws) as w from d where len(ws) > 1 union all select doc_id, pos, 1, ws[pos] from l),
g as (select doc_id, line, n_lines, {grams} as g from u where len(w) >= 2),
plain as (select doc_id, line, n_lines, license, template, {value} as dice from g join t on len(g) between len(tg) * {low} and len(tg) * {high}),
able as (select doc_id, template from (select doc_id, {grams} as g from (select doc_id, flatten(ws) as w from d) where len(w) >= 2) join t on len(list_intersect(g, tg)) >= len(tg) * {low}),
e as (select a.doc_id, a.ws, a.pos, t.template, t.license, t.tg, min(z.pos) as last from able join c a on a.doc_id = able.doc_id join t on t.template = able.template and a.n > 0 and a.n < tn * {FULL}
      join c z on z.doc_id = a.doc_id and z.pos > a.pos and z.upto - a.upto + a.n >= tn * {FULL} and z.pos - a.pos < 2 * tn + 16 group by all),
x as (select doc_id, pos, last, template, license, tg, {grams} as g from (select *, flatten(ws[pos:last]) as w from e where pos > 1 or last < len(ws))),
y as (select doc_id, pos, last, template, license, case when len(g) between len(tg) * {low} and len(tg) * {high} then {value} else 0 end as dice from x),
best as (select y.*, coalesce(p.dice, 0) as before, coalesce(q.dice, 0) as after from y left join y p on p.doc_id = y.doc_id and p.template = y.template and p.pos = y.pos - 1
         left join y q on q.doc_id = y.doc_id and q.template = y.template and q.pos = y.pos + 1)
select doc_id, line::int as line, n_lines::int as n_lines, license, template::int as template, round(dice, 9) as dice from (
  select * from plain union all select doc_id, pos, last - pos + 1, license, template, dice from best where dice > before and dice >= after)
where dice >= {dice}
"""


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLE_SQL = {"op4_license_scan": _sql(TEMPLATES, DICE)}
