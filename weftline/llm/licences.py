"""Licence texts in documents, by Dice coefficient over word bigrams, with DataFrame functions only.

A document's units are its lines, its paragraphs (parted by lines without letters and digits, as blank ones are), its
whole text, and windows of words, normalised to lower-case words. Windows find a template within a larger paragraph: each
template has seeds, pairs of neighbouring words of which about one stands in any stretch of SEED_WORDS; where the text
has such a pair, the window that is as long as the template and holds the pair at the same place is a unit, compared with
this template only. A unit is compared
with a template if their sizes allow the threshold: 2 * min(a, b) / (a + b) bounds the Dice coefficient of bigram sets of
a and b bigrams, so that each template has a range of sizes, and units outside of all ranges are never compared. A unit
that reaches the threshold also shares dice / (2 - dice) of a template's bigrams at least, so it holds one of any set of
words that touches more than the others of them: a unit without such an anchor word is left out before it is cut up.

The templates (TEMPLATES, or the caller's, MAX_TEMPLATES at most) are a literal of the plan: nothing is joined or
shuffled.

Defined results: null and empty texts and texts without a match have n_matches 0 and null licence; a text of any length is
one unit too, and left out by its size, while its windows are looked for in all of it; a window that begins before the
text or ends after it is cut there;
the best match is the one with the most bigrams in common (the whole of a licence before one of its paragraphs), then with the
larger coefficient; ties go to the template first in order; repeated rows give repeated results; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import collections
import functools
import json
import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

DICE = 0.7
MAX_TEMPLATES = 2000
#: Notices by which works are put under public licences, and the MIT, BSD and ISC licences by paragraph and whole.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "Licensed under the GNU General Public License, Version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
)


def normal_words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """The distinct word bigrams; a single word stands for itself."""
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(words)


def template_table(docs: DataFrame, templates=TEMPLATES, dice: float = DICE) -> DataFrame:
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates can be broadcast")
    rows = docs.sparkSession.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "place int, licence string, template string")
    rows = rows.withColumn("t_words", normal_words(F.col("template"))).withColumn("t_grams", bigrams(F.col("t_words"))).withColumn("t_size", F.size("t_grams"))
    ratio = dice / (2 - dice)  # of the smaller to the larger size
    return rows.withColumn("low", F.ceil(F.col("t_size") * ratio - 1e-9)).withColumn("high", F.floor(F.col("t_size") / ratio + 1e-9))


#: Words of nearly every English text, which are taken for anchors last.
COMMON = frozenset("a all an and any are as at be by do for from has have if in is it its may no not of on or other so such than that the their this to use was what when which will with without you your".split())


def anchor_words(grams: list[list[str]], dice: float) -> list[str]:
    """Words of which any matching unit holds one: for each template its longest words, those of other templates first
    and common ones last, until they touch more bigrams than may be missing; words that hold another one of them (as a
    part) aren't needed."""
    out: set[str] = set()
    for own in grams:
        missing = len(own) - math.ceil(dice * len(own) / (2 - dice) - 1e-9)
        touched: set[str] = set()
        for word in sorted({w for g in own for w in g.split(" ")}, key=lambda w: (w not in out, w in COMMON, w.isdigit(), -len(w), w)):
            if len(touched) > missing:
                break
            if fresh := {g for g in own if word in g.split(" ")} - touched:
                touched |= fresh
                out.add(word)
    return sorted(w for w in out if not any(x != w and len(x) > WHOLE and x in w for x in out))


#: Anchor words up to this length count only as whole words: as parts they are everywhere.
WHOLE = 3


#: Words of a template in which one pair is a seed, about; short templates have at least four stretches.
SEED_WORDS = 12


def seeds(words: list[str], every: int = SEED_WORDS) -> list[tuple[int, str, str]]:
    """(place, word, next word) of the pairs that mark a template: in each stretch the one with the fewest common words
    and the most letters, of those that stand once in it."""
    pairs = list(zip(words, words[1:], strict=False))
    times = collections.Counter(pairs)
    once = [(sum(w in COMMON or w.isdigit() for w in p), -len("".join(p)), i) for i, p in enumerate(pairs) if times[p] == 1]
    step = max(1, min(every, len(pairs) // 4))
    best: dict[int, tuple] = {}
    for mark in once:
        best[mark[2] // step] = min(mark, best.get(mark[2] // step, mark))
    return [(i, *pairs[i]) for _, _, i in best.values()]


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether lower-case text holds one of the words, as a part or, of short ones, as a whole."""
    short, long = [w for w in words if len(w) <= WHOLE], [w for w in words if len(w) > WHOLE]
    whole = "|".join(rf"{w}(?<![\p{{L}}\p{{N}}]{w})(?![\p{{L}}\p{{N}}])" for w in map(re.escape, short))
    tests = [F.rlike(text, F.lit(whole))] if short else []
    if len(long) > 128:
        tests.append(F.rlike(text, F.lit("|".join(map(re.escape, long)))))
    else:
        tests = [F.contains(text, F.lit(w)) for w in long] + tests
    return functools.reduce(lambda a, b: a | b, tests)


def licence_matches(docs: DataFrame, templates=TEMPLATES, dice: float = DICE) -> DataFrame:
    """doc_id, n_matches (templates that a unit matches), licence and dice of the best match, for every document."""
    ship(docs.sparkSession)
    table = template_table(docs, templates, dice)
    known = table.orderBy("place").collect()  # the templates, MAX_TEMPLATES at most
    anchors = anchor_words([list(r["t_grams"]) for r in known], dice)
    least, most = F.lit(min(int(r["low"]) for r in known)), F.lit(max(int(r["high"]) for r in known))
    # lower case once a text: each of the anchors looks at it
    low = docs.select("doc_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("__lower"))
    text = F.col("__lower")
    lines = F.split(text, "\n")
    # lines without a letter or digit, blank ones or those between the paragraphs of a comment, part paragraphs
    paragraphs = F.split(text, r"\n[^\p{L}\p{N}\n]*(?=\n)")
    none = F.array().cast("array<string>")
    units = F.concat(lines, F.when(F.size(paragraphs) > 1, paragraphs).otherwise(none), F.when(F.size(lines) > 1, F.array(text)).otherwise(none))
    units = F.filter(units, lambda u: holds_any(u, anchors))
    grams = F.filter(F.transform(F.transform(units, normal_words), bigrams), lambda g: F.size(g).between(least, most))
    fields = ("place", "licence", "t_grams", "t_size", "low", "high")
    literal = F.from_json(F.lit(json.dumps([{f: r[f] for f in fields} for r in known])), "array<struct<place:int,licence:string,t_grams:array<string>,t_size:int,low:long,high:long>>")
    marks = [{"place": i, "at": at, "pair": f"{x} {y}", "n": len(r["t_words"])} for i, r in enumerate(known) for at, x, y in seeds(list(r["t_words"]))]
    mark_literal = F.from_json(F.lit(json.dumps(marks)), "array<struct<place:int,at:int,pair:string,n:int>>")
    held = holds_any(text, anchors)
    units = low.select(
        "doc_id",
        F.when(held, grams).otherwise(F.array().cast("array<array<string>>")).alias("grams"),
        F.when(held, normal_words(text)).otherwise(none).alias("words"),
    )

    # where a seed's first word stands, then where the pair does: only these few places are looked at closely
    first, pair = sorted({m["pair"].split(" ")[0] for m in marks}), sorted({m["pair"] for m in marks})
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(first), i)), lambda i: i.isNotNull())

    def pair_at(i: Column) -> Column:
        return F.concat_ws(" ", F.get("words", i), F.get("words", i + 1))

    def windows(i: Column) -> Column:
        return F.transform(F.filter(mark_literal, lambda m: m["pair"] == pair_at(i)), lambda m: F.struct(m["place"].alias("place"), (i - m["at"]).alias("start"), m["n"].alias("n")))

    def window_match(m: Column) -> Column:
        begin = F.greatest(m["start"], F.lit(0))
        return F.transform(F.array(bigrams(F.slice("words", begin + 1, m["start"] + m["n"] - begin))), lambda g: match(g, F.get(literal, m["place"])))

    def match(g: Column, t: Column) -> Column:
        shared = F.size(F.array_intersect(g, t["t_grams"])).alias("shared")
        return F.struct(shared, (shared * 2.0 / (F.size(g) + t["t_size"])).alias("dice"), (-t["place"]).alias("place"), t["licence"].alias("licence"))

    def best(g: Column) -> Column:
        return F.transform(F.filter(literal, lambda t: F.size(g).between(t["low"], t["high"])), lambda t: match(g, t))

    seen = units.select("doc_id", "grams", "words", F.filter(places, lambda i: pair_at(i).isin(pair)).alias("at"))
    seen = seen.select("doc_id", "grams", "words", F.array_distinct(F.flatten(F.transform("at", windows))).alias("windows"))
    all_matches = F.concat(F.flatten(F.transform("grams", best)), F.flatten(F.transform("windows", window_match)))
    found = seen.select("doc_id", F.filter(all_matches, lambda m: m["dice"] >= dice).alias("m"))
    top = F.array_max("m")
    n = F.size(F.array_distinct(F.transform("m", lambda m: m["place"])))
    return found.select("doc_id", n.cast("long").alias("n_matches"), top["licence"].alias("licence"), F.round(top["dice"], 9).alias("dice"))


def licence_sql(templates=TEMPLATES, dice: float = DICE) -> str:
    """The same for DuckDB, comparing every unit of a fitting size without anchors; of the seeds it takes the places."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(templates))
    marks = [(i, len(w), *m) for i, (_, text) in enumerate(templates) for w in [re.findall(r"[^\W_]+", text.lower())] for m in seeds(w)]
    mark_rows = ", ".join(f"({i}, {n}, {at}, '{x}', '{y}')" for i, n, at, x, y in marks)
    words = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    grams = "CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END"
    ratio = dice / (2 - dice)
    return f"""
WITH t AS (SELECT place, licence, {grams} AS tg FROM (SELECT place, licence, {words.format("template")} AS w FROM (VALUES {rows}) v(place, licence, template))),
sized AS (SELECT *, len(tg) AS n, ceil(len(tg) * {ratio!r}::DOUBLE - 1e-9) AS low, floor(len(tg) / {ratio!r}::DOUBLE + 1e-9) AS high FROM t),
split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, len(ls) AS n, u.i, ls[u.i] AS line FROM split, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) u),
parts AS (SELECT *, i > 1 AND i < n AND NOT regexp_matches(line, '[\\p{{L}}\\p{{N}}]') AS sep FROM lines),
runs AS (SELECT *, sum(CASE WHEN sep THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run, bool_or(sep) OVER (PARTITION BY doc_id) AS parted FROM parts),
units AS (SELECT doc_id, line AS u FROM lines
  UNION ALL SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FROM runs WHERE parted AND NOT sep GROUP BY doc_id, run
  UNION ALL SELECT doc_id, text FROM documents WHERE contains(text, chr(10))),
cut AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {words.format("u")} AS w FROM units)),
marks AS (SELECT * FROM (VALUES {mark_rows}) v(place, t_words, spot, x, y)),
texts AS (SELECT doc_id, {words.format("text")} AS ws FROM documents),
pairs AS (SELECT doc_id, u.i, ws[u.i] AS x, ws[u.i + 1] AS y FROM texts, LATERAL (SELECT unnest(range(1, len(ws))) AS i) u),
spots AS (SELECT DISTINCT doc_id, place, t_words, i - spot AS start FROM pairs JOIN marks USING (x, y)),
windows AS (SELECT doc_id, place, {grams} AS g FROM (SELECT doc_id, place, ws[greatest(start, 1):start + t_words - 1] AS w FROM spots JOIN texts USING (doc_id))),
common AS (SELECT doc_id, place, licence, len(list_intersect(g, tg)) AS shared, len(g) + n AS both_sizes FROM cut JOIN sized ON len(g) BETWEEN low AND high
  UNION ALL SELECT doc_id, place, licence, len(list_intersect(g, tg)), len(g) + n FROM windows JOIN sized USING (place)),
scored AS (SELECT *, shared * 2.0::DOUBLE / both_sizes AS dice FROM common),
best AS (SELECT doc_id, count(DISTINCT place) AS n_matches, arg_max(struct_pack(l := licence, d := dice), struct_pack(s := shared, d := dice, p := -place)) AS b FROM scored WHERE dice >= {dice!r}::DOUBLE GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, b.l AS licence, round(b.d, 9) AS dice FROM documents d LEFT JOIN best USING (doc_id)
"""


def template_files(folder: str) -> tuple[tuple[str, str], ...]:
    """(file name, text) of the licence texts in a folder on the driver, in order of their names: whole licences as templates."""
    return tuple((p.name.removesuffix(".txt"), p.read_text(errors="replace")) for p in sorted(Path(folder).iterdir()) if p.is_file())
