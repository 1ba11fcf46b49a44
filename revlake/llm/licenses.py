"""License scans: known sentences become identifiers, whose order is matched against licence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence sentences in normalised form (small letters, runs of other characters as one space).
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-the-license": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-may-not-use": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-3-licensed": "licensed under the gnu general public license version 3",
    "gpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "mpl-2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-work": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
}
#: A licence's rules, each an ordered list of sentence identifiers; other sentences may stand between.
RULES = (
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-notice-the-license", "apache-obtain", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-may-not-use", "apache-obtain", "apache-as-is", "apache-see")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-permission", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT-no-notice", ("mit-permission", "mit-as-is", "mit-liability")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("ISC", ("isc-permission", "isc-as-is")),
    ("GPL-3.0", ("gpl-3-work",)),
    ("GPL-3.0", ("gpl-3-licensed",)),
    ("GPL-3.0-or-later", ("gpl-3-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-hope", "gpl-see")),
    ("MPL-2.0", ("mpl-2-form", "mpl-2-copy")),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-4-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-work",)),
    ("CC0-1.0", ("cc0-work",)),
    ("Unlicense", ("unlicense-free",)),
    ("All-Rights-Reserved", ("reserved",)),
)
#: A licence's match is dropped where a stricter rule that contains its sentences holds too (fixed values).
IMPLIED = {"BSD-2-Clause": "BSD-3-Clause", "MIT-no-notice": "MIT"}

#: Sentences end at a full stop, question or exclamation mark before a blank; lines end them too, or only empty lines do.
LINES, WRAPPED = r"(?<=[.!?])\s+|\n+", r"(?<=[.!?])\s+|\n\s*\n"


def normalise(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def identifiers(text: Column, ends: str) -> Column:
    """The known sentences' identifiers, in the text's order."""
    known = F.create_map(*(F.lit(x) for key, s in SENTENCES.items() for x in (s, key)))
    return F.filter(F.transform(F.split(text, ends), lambda s: F.try_element_at(known, normalise(s))), lambda i: i.isNotNull())


def _holds(ids: Column, rule: tuple[str, ...]) -> Column:
    """Whether the rule's identifiers occur in order: each step waits for the next one."""
    wanted = F.array(*map(F.lit, rule))
    done = F.aggregate(ids, F.lit(0), lambda n, i: F.when((n < len(rule)) & (F.try_element_at(wanted, n + 1) == i), n + 1).otherwise(n))
    return done == len(rule)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (names in order, comma-joined), sentences (known ones found) and sequence (their identifiers).

    Every whole text is read twice, with its lines as sentence ends and with lines taken as wrapped; a
    licence is found if a rule holds in either reading. One projection: nothing is shuffled, so neither
    a common licence nor a hot source matters. Null and empty texts have no licences; null ids and
    repeated rows each keep their row; an empty table gives none; further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"), identifiers(text, LINES).alias("by_line"), identifiers(text, WRAPPED).alias("wrapped"))
    found = F.filter(F.array(*(F.when(_holds(F.col("by_line"), r) | _holds(F.col("wrapped"), r), F.lit(name)) for name, r in RULES)), lambda x: x.isNotNull())
    rows = rows.withColumn("found", F.array_sort(F.array_distinct(F.when(F.size("by_line") + F.size("wrapped") > 0, found).otherwise(F.array().cast("array<string>")))))
    drop = F.array(*(F.when(F.array_contains("found", strict), F.lit(loose)) for loose, strict in IMPLIED.items()))
    longer = F.when(F.size("wrapped") > F.size("by_line"), F.col("wrapped")).otherwise(F.col("by_line"))
    return rows.select(
        "doc_id",
        F.array_join(F.filter("found", lambda x: ~F.coalesce(F.array_contains(F.array_compact(drop), x), F.lit(False))), ",").alias("licenses"),
        F.size(longer).cast("bigint").alias("sentences"),
        F.array_join(longer, ",").alias("sequence"),
    )


def _sql_reading(name: str, ends: str) -> str:
    """Known sentences of one reading, as '<id><id>...' in the text's order; chr(1) marks the ends."""
    pieces = f"string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), '{ends}', chr(1), 'g'), chr(1))"
    return (
        f"{name}_p AS (SELECT doc_id, unnest({pieces}) AS piece, generate_subscripts({pieces}, 1) AS nth FROM documents),\n"
        f"{name} AS (SELECT doc_id, string_agg('<' || known.id || '>', '' ORDER BY nth) AS ids, count(*) AS n FROM {name}_p\n"
        f"  JOIN known ON trim(regexp_replace(lower(piece), '[^a-z0-9]+', ' ', 'g')) = known.sentence GROUP BY doc_id)"
    )


def oracle() -> str:
    """DuckDB SQL for scan() over a documents table with unique ids."""
    known = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    held: dict[str, list[str]] = {}
    for name, rule in RULES:
        like = "%" + "%".join(f"<{k}>" for k in rule) + "%"
        held.setdefault(name, []).append(f"l LIKE '{like}' OR w LIKE '{like}'")
    tests = {name: f"({' OR '.join(parts)})" for name, parts in held.items()}
    for loose, strict in IMPLIED.items():
        tests[loose] = f"({tests[loose]} AND NOT {tests[strict]})"
    names = ", ".join(f"CASE WHEN {tests[name]} THEN '{name}' END" for name in sorted(tests))
    return f"""
WITH known(id, sentence) AS (VALUES {known}),
{_sql_reading("by_line", chr(92) + "n+")},
{_sql_reading("wrapped", chr(92) + "n" + chr(92) + "s*" + chr(92) + "n")},
found AS (SELECT d.doc_id, coalesce(b.ids, '') AS l, coalesce(r.ids, '') AS w, coalesce(b.n, 0) AS ln, coalesce(r.n, 0) AS wn
  FROM documents d LEFT JOIN by_line b ON d.doc_id = b.doc_id LEFT JOIN wrapped r ON d.doc_id = r.doc_id)
SELECT doc_id, concat_ws(',', {names}) AS licenses, CASE WHEN wn > ln THEN wn ELSE ln END AS sentences,
  replace(trim(CASE WHEN wn > ln THEN w ELSE l END, '<>'), '><', ',') AS sequence
FROM found
"""
