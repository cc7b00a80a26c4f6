"""License scans by sentence rules.

A text is cut into sentences, at line ends and a second time with line ends
taken as spaces, so that wrapped sentences are found too. Sentences are
normalised (letters a-z, digits and inner full stops, single spaces) and mapped
to the identifiers of known licence sentences. Ordered rules, each a sequence
of identifiers, are then tried on the identifier sequence of a text: the first
rule that fits takes its identifiers, so longer rules come first.

:func:`oracle_sql` states these two cuts. :func:`scan` with ``paragraphs`` makes
a third one for hard-wrapped files, in which headings, copyright lines and list
numbers stand without a full stop: paragraphs are kept apart and their line ends
taken as spaces, sentences end at colons and list numbers too, comment marks at
line starts are dropped, and identifiers of parts are matched by further rules.

Everything happens inside the row with SQL functions: no shuffle, no Python.

Cases: null or empty text holds no licence; a text may hold several, each is
reported once; repeated rows and ids are scanned each; empty tables give empty
results; further columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

# Sentences of public licences and notices, normalised.
SENTENCES = {
    1: "released under the mit license",
    2: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    3: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    4: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    5: "licensed under the mit license",
    6: "this project is licensed under the mit license",
    10: "licensed under the apache license version 2.0",
    11: "licensed under the apache license version 2.0 the license",
    12: "you may not use this file except in compliance with the license",
    13: "you may obtain a copy of the license at http www.apache.org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    14: "see the license for the specific language governing permissions and limitations under the license",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    22: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    23: "see the gnu general public license for more details",
    24: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    30: "licensed under cc by nc 4.0",
    31: "licensed under cc by 4.0",
    32: "licensed under cc by sa 4.0",
    33: "this work is licensed under a creative commons attribution 4.0 international license",
    34: "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    35: "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    40: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    41: "licensed under the bsd 3 clause license",
    42: "licensed under the mozilla public license version 2.0",
    43: "this source code form is subject to the terms of the mozilla public license v. 2.0",
}
# Sequences of sentences and the licence they stand for, in the order they are tried.
RULES = [
    ((2, 3, 4), "MIT"),
    ((11, 12, 13, 14), "Apache-2.0"),
    ((21, 22, 23), "GPL-3.0-or-later"),
    ((24, 22, 23), "GPL-2.0-or-later"),
    ((1,), "MIT"),
    ((5,), "MIT"),
    ((6,), "MIT"),
    ((2,), "MIT"),
    ((10,), "Apache-2.0"),
    ((11,), "Apache-2.0"),
    ((20,), "GPL-3.0"),
    ((21,), "GPL-3.0-or-later"),
    ((24,), "GPL-2.0-or-later"),
    ((30,), "CC-BY-NC-4.0"),
    ((31,), "CC-BY-4.0"),
    ((32,), "CC-BY-SA-4.0"),
    ((33,), "CC-BY-4.0"),
    ((34,), "CC-BY-SA-4.0"),
    ((35,), "CC-BY-NC-4.0"),
    ((40,), "BSD"),
    ((41,), "BSD-3-Clause"),
    ((42,), "MPL-2.0"),
    ((43,), "MPL-2.0"),
]
# Parts that only the cut at paragraphs gives, and the rules over them, tried before RULES.
PARTS = {
    50: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    51: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    52: "you may obtain a copy of the license at",
    53: "http www.apache.org licenses license 2.0",
    54: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    55: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    56: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    57: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    58: "apache license version 2.0 january 2004 http www.apache.org licenses",
    59: "gnu general public license version 3 29 june 2007",
    60: "gnu general public license version 2 june 1991",
    61: "this program is free software",
    62: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    63: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
}
PART_RULES = [
    ((50, 51, 3, 4), "MIT"),
    ((50, 51), "MIT"),
    ((11, 12, 52, 53, 54, 14), "Apache-2.0"),
    ((40, 55, 56, 57), "BSD-3-Clause"),
    ((40, 55, 56), "BSD-2-Clause"),
    ((61, 62, 22, 23), "GPL-3.0-or-later"),
    ((61, 63, 22, 23), "GPL-2.0-or-later"),
    ((50,), "MIT"),
    ((62,), "GPL-3.0-or-later"),
    ((63,), "GPL-2.0-or-later"),
    ((58,), "Apache-2.0"),
    ((59,), "GPL-3.0"),
    ((60,), "GPL-2.0"),
]
# Tried after all others, on what they leave.
LAST_RULES = [((3, 4), "MIT"), ((22, 23), "GPL")]
#: Each known sentence holds one of these; texts without any are not cut at all.
TRIGGERS = ("licens", "software", "warrant", "permitted")
CUT = r"\n+|[.!?]+\s+"
PARAGRAPH_CUT = r"\n+|[.!?:]+\s+"


def _paragraphs(text: Column) -> Column:
    """The text with one line a paragraph: comment marks are dropped, list items
    and copyright lines are paragraphs, single line ends become spaces."""
    steps = [(r"\r\n?|\f", "\n"),
             (r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|<!--+)?[ \t]*|[ \t]+$", ""),
             (r"(?mi)^(copyright[ \t]+(?:\(c\)|©|[0-9]{4}).*)$", "\n$1\n"),
             (r"(?<=\A|\n\n|[.:;,]\n|\band\n|\bor\n)(?:[0-9]{1,2}[.)]|\([a-z0-9]{1,2}\)|-)[ \t]+", "\n\n"),
             (r"\n\n+", "\r"), (r"\n", " "), (r"\r", "\n")]
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def _sequence(text: Column, sentences: dict = SENTENCES, cut: str = CUT) -> Column:
    """Identifiers of the known sentences of a text in order, as ``<1><20>``."""
    known = F.create_map(*[x for i, s in sentences.items() for x in (F.lit(s), F.lit(f"<{i}>"))])
    plain = lambda s: F.lower(F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9.]+", " "), r"^[ .]+|[ .]+$", ""))
    return F.array_join(F.filter(F.transform(F.split(text, cut), lambda s: F.try_element_at(known, plain(s))), lambda x: x.isNotNull()), "")


def _apply(sequence: Column, ordered: list = RULES) -> Column:
    """The licences of a sequence, in the order of the rules."""
    rules = F.array(*[F.struct(F.lit("".join(f"<{i}>" for i in ids)).alias("ids"), F.lit(name).alias("name")) for ids, name in ordered])
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(rules, start, lambda a, r: F.struct(
        F.replace(a["left"], r["ids"], F.lit("|")).alias("left"),
        F.when(F.contains(a["left"], r["ids"]), F.array_append(a["found"], r["name"])).otherwise(a["found"]).alias("found")))["found"]


def scan(docs: DataFrame, paragraphs: bool = False) -> DataFrame:
    """doc_id, sentences and wrapped (identifier sequences of both cuts), licenses
    (distinct, sorted, comma-joined) of every document; with ``paragraphs`` also
    the sequence of the third cut, whose licences count too."""
    d = documents(docs)
    low = F.lower(F.col("text"))
    hit = F.lit(False)
    for t in TRIGGERS:
        hit = hit | F.contains(low, F.lit(t))
    d = (d.withColumn("hit", hit)
         .withColumn("sentences", F.when(F.col("hit"), _sequence(F.col("text"))).otherwise(""))
         .withColumn("wrapped", F.when(F.col("hit"), _sequence(F.regexp_replace("text", r"\s+", " "))).otherwise("")))
    found = [_apply(F.col("sentences")), _apply(F.col("wrapped"))]
    if paragraphs:
        third = _sequence(_paragraphs(F.col("text")), SENTENCES | PARTS, PARAGRAPH_CUT)
        d = d.withColumn("paragraphs", F.when(F.col("hit"), third).otherwise(""))
        found.append(_apply(F.col("paragraphs"), PART_RULES + RULES + LAST_RULES))
    every = F.array_distinct(F.concat(*found))
    if paragraphs:  # a name without version says nothing beside one with it
        every = F.filter(every, lambda x: ~x.isin("BSD", "GPL") | ~F.exists(every, lambda y: y.startswith(F.concat(x, F.lit("-")))))
    return d.select("doc_id", "sentences", "wrapped", *(["paragraphs"] if paragraphs else []),
                    F.array_join(F.array_sort(every), ",").alias("licenses"))


def oracle_sql() -> str:
    """The result of :func:`scan` in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, '<{i}>')" for i, s in SENTENCES.items())
    steps, last = [], "seqs"
    for k, (ids, name) in enumerate(RULES):
        x = "".join(f"<{i}>" for i in ids)
        steps.append(f"r{k} AS (SELECT rid, kind, replace(rest, '{x}', '|') AS rest, "
                     f"CASE WHEN contains(rest, '{x}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})")
        last = f"r{k}"
    return rf"""
WITH known(s, id) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, 'sentences' AS kind, text FROM d UNION ALL SELECT rid, 'wrapped', regexp_replace(text, '\s+', ' ', 'g') FROM d),
c AS (SELECT rid, kind, regexp_split_to_array(text, '\n+|[.!?]+\s+') AS parts FROM t),
p AS (SELECT rid, kind, unnest(parts) AS s, unnest(range(len(parts))) AS i FROM c),
n AS (SELECT rid, kind, i, lower(regexp_replace(regexp_replace(s, '[^A-Za-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')) AS s FROM p),
k AS (SELECT rid, kind, string_agg(id, '' ORDER BY i) AS ids FROM n JOIN known USING (s) GROUP BY rid, kind),
seqs AS (SELECT t.rid, t.kind, coalesce(ids, '') AS rest, CAST([] AS VARCHAR[]) AS found FROM t LEFT JOIN k ON t.rid = k.rid AND t.kind = k.kind),
{", ".join(steps)},
f AS (SELECT rid, string_agg(DISTINCT x, ',' ORDER BY x) AS licenses FROM (SELECT rid, unnest(found) AS x FROM {last}) GROUP BY rid)
SELECT doc_id, coalesce(a.ids, '') AS sentences, coalesce(b.ids, '') AS wrapped, coalesce(f.licenses, '') AS licenses
FROM d LEFT JOIN f ON d.rid = f.rid
LEFT JOIN k a ON a.rid = d.rid AND a.kind = 'sentences' LEFT JOIN k b ON b.rid = d.rid AND b.kind = 'wrapped'
"""
