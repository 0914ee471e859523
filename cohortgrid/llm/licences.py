"""Licence scans by sentence rules, in DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, by identifier. Case, punctuation and
# line ends don't matter.
SENTENCES = {
    "MitReleased": "Released under the MIT License.",
    "MitLicensed": "Licensed under the MIT License.",
    "MitGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MitWarranty": "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "MitLiability": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    "ApacheLicensed": "Licensed under the Apache License, Version 2.0.",
    "ApacheThe": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "ApacheUse": "you may not use this file except in compliance with the License.",
    "ApacheObtain": "You may obtain a copy of the License at",
    "ApacheUnless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GplThree": "This work is licensed under the GNU General Public License, version 3.",
    "GplTwo": "This work is licensed under the GNU General Public License, version 2.",
    "GplFree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GplFreeTwo": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GplHope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "GplDetails": "See the GNU General Public License for more details.",
    "CcByNc": "Licensed under CC BY-NC 4.0.",
    "CcBy": "Licensed under CC BY 4.0.",
    "CcBySa": "Licensed under CC BY-SA 4.0.",
    "CcZero": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BsdUse": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BsdSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BsdBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BsdNames": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "IscGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MplSubject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "SpdxMit": "SPDX-License-Identifier: MIT",
    "SpdxApache": "SPDX-License-Identifier: Apache-2.0",
    "SpdxGplThree": "SPDX-License-Identifier: GPL-3.0-only",
    "AllRights": "All rights reserved.",
}

# Rules in the order they are tried; a rule takes its sentences, so that a later and
# shorter one can't take them again.
RULES = [
    ("MIT", ["MitGrant", "MitNotice", "MitWarranty", "MitLiability"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("Apache-2.0", ["ApacheThe", "ApacheUse", "ApacheObtain", "ApacheUnless"]),
    ("Apache-2.0", ["ApacheThe", "ApacheUse", "ApacheObtain"]),
    ("Apache-2.0", ["ApacheThe", "ApacheUse"]),
    ("GPL-3.0-or-later", ["GplFree", "GplHope", "GplDetails"]),
    ("GPL-3.0-or-later", ["GplFree"]),
    ("GPL-2.0-or-later", ["GplFreeTwo", "GplHope", "GplDetails"]),
    ("GPL-2.0-or-later", ["GplFreeTwo"]),
    ("BSD-3-Clause", ["BsdUse", "BsdSource", "BsdBinary", "BsdNames"]),
    ("BSD-2-Clause", ["BsdUse", "BsdSource", "BsdBinary"]),
    ("ISC", ["IscGrant"]),
    ("MPL-2.0", ["MplSubject"]),
    ("CC0-1.0", ["CcZero"]),
    ("GPL-3.0-only", ["GplThree"]),
    ("GPL-3.0-only", ["SpdxGplThree"]),
    ("GPL-2.0-only", ["GplTwo"]),
    ("CC-BY-NC-4.0", ["CcByNc"]),
    ("CC-BY-SA-4.0", ["CcBySa"]),
    ("CC-BY-4.0", ["CcBy"]),
    ("Apache-2.0", ["ApacheLicensed"]),
    ("Apache-2.0", ["SpdxApache"]),
    ("MIT", ["MitReleased"]),
    ("MIT", ["MitLicensed"]),
    ("MIT", ["SpdxMit"]),
    ("NOASSERTION", ["MitGrant"]),
    ("NOASSERTION", ["BsdUse"]),
    ("NOASSERTION", ["AllRights"]),
]

# Where sentences end, and what is no part of a normalised sentence.
WHITE = r"[ \t\n\r\f\x0B]"
LINE_END = r"[\n\r\f\x0B]+"
WRAPPED = r"([^\n\r])\r?\n([^\n\r])"
STOP = rf"[.!?;]{WHITE}+|:[ \t]*[\n\r]"
NOISE = r"[^A-Za-z0-9\n]+"
BREAK = r" ?\n[ \n]*"


def parts(sentence: str) -> list[str]:
    """A known sentence as the splitter gives it: lower case, one blank between words; a stop inside it ends a part too."""
    text = re.sub(NOISE, " ", re.sub(STOP, "\n", re.sub(WHITE + "+", " ", sentence) + " "))
    return [p for p in (x.strip().lower() for x in re.split(BREAK, text)) if p]


def _tables() -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Number of each known part, and (sequence, licence) of each rule, as the scan uses them."""
    numbers: dict[str, int] = {}
    own = {}
    for name, sentence in SENTENCES.items():
        own[name] = [numbers.setdefault(p, len(numbers) + 1) for p in parts(sentence)]
    rules = [("".join(f"|{n}|" for name in names for n in own[name]), licence) for licence, names in RULES]
    return numbers, rules


def sentences(text: Column, wrapped: bool) -> Column:
    """Normalised sentences in order. wrapped: a single line end inside a paragraph is a blank."""
    plain = F.regexp_replace(text, WRAPPED, "$1 $2") if wrapped else text
    ended = F.regexp_replace(F.regexp_replace(plain, STOP, "\n"), LINE_END, "\n")
    return F.split(F.lower(F.regexp_replace(ended, NOISE, " ")), BREAK)


def recognised(text: Column, wrapped: bool) -> Column:
    """The text's sentence numbers as '|3||4|', '|0|' for a run of unknown sentences between known ones."""
    numbers, _ = _tables()
    known = F.array(*[F.lit(s) for s in numbers])
    found = F.transform(sentences(text, wrapped), lambda s: F.array_position(known, F.trim(s)))
    return F.regexp_replace(F.array_join(F.transform(found, lambda n: F.concat(F.lit("|"), n.cast("string"), F.lit("|"))), ""), r"(\|0\|)+", "|0|")


def applied(line: Column) -> Column:
    """Licences of a recognised text: every rule in its order, on what the rules before it left."""
    _, rules = _tables()
    table = F.array(*[F.struct(F.lit(seq).alias("seq"), F.lit(lic).alias("licence")) for seq, lic in rules])
    start = F.struct(line.alias("line"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["line"], rule["seq"])
        return F.struct(
            F.replace(state["line"], rule["seq"], F.lit("|0|")).alias("line"),
            F.when(hit, F.array_append(state["found"], rule["licence"])).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(table, start, step, lambda s: F.array_distinct(s["found"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_known, sentence_line, licenses: one row per row of `docs`.

    Sentences end at . ! ? ; before white space, at a colon before a line end, and at line ends;
    a text is also read with its single line ends as blanks, as hard-wrapped licence texts need.
    n_known and sentence_line (numbers of known sentences in order, |0| for others between) are of
    the first reading; licenses has what the rules find in either, sorted, comma-joined. Null,
    empty and licence-free texts have 0, '' or '|0|', ''. No row is shuffled; repeated rows come
    back as often as given; other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), recognised(text, False).alias("line"), recognised(text, True).alias("other"))
    some = F.when(F.col("line").rlike("[1-9]") | F.col("other").rlike("[1-9]"), F.array_sort(F.array_distinct(F.concat(applied(F.col("line")), applied(F.col("other"))))))
    n_known = F.regexp_count("line", F.lit(r"[1-9][0-9]*")).cast("long")
    return read.select("doc_id", n_known.alias("n_known"), F.col("line").alias("sentence_line"), F.coalesce(F.array_join(some, ","), F.lit("")).alias("licenses"))


def scan_sql() -> str:
    """The same in DuckDB SQL."""
    numbers, rules = _tables()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "[" + ", ".join(map(quote, numbers)) + "]"

    def line(text: str) -> str:
        ended = f"regexp_replace(regexp_replace({text}, '{STOP}', chr(10), 'g'), '{LINE_END}', chr(10), 'g')"
        split = f"string_split_regex(lower(regexp_replace({ended}, '{NOISE}', ' ', 'g')), '{BREAK}')"
        found = f"list_transform({split}, lambda s: '|' || CAST(coalesce(list_position({known}, trim(s)), 0) AS VARCHAR) || '|')"
        return f"regexp_replace(array_to_string({found}, ''), '(\\|0\\|)+', '|0|', 'g')"

    sql = [
        "WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS x FROM documents)",
        f"l0 AS (SELECT r, {line('x')} AS s, CAST([] AS VARCHAR[]) AS f FROM t UNION ALL SELECT r, {line(f'regexp_replace(x, {quote(WRAPPED)}, {quote(chr(92) + "1 " + chr(92) + "2")}, {quote("g")})')}, [] FROM t)",
    ]
    for i, (seq, lic) in enumerate(rules):
        sql.append(f"l{i + 1} AS (SELECT r, replace(s, {quote(seq)}, '|0|') AS s, CASE WHEN contains(s, {quote(seq)}) THEN list_append(f, {quote(lic)}) ELSE f END AS f FROM l{i})")
    sql.append(f"g AS (SELECT r, list_sort(list_distinct(flatten(list(f)))) AS f FROM l{len(rules)} GROUP BY r)")
    sql.append(f"n AS (SELECT doc_id, r, {line('x')} AS s FROM t)")
    return ", ".join(sql) + " SELECT doc_id, len(regexp_extract_all(s, '[1-9][0-9]*')) AS n_known, s AS sentence_line, array_to_string(f, ',') AS licenses FROM n JOIN g USING (r)"
