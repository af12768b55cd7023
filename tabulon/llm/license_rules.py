"""License scans: sentences to identifiers, identifier sequences to ordered rules.

A text is cut into sentences; a sentence (or one line of it) whose normal form is known gets
its identifier; a rule matches where its identifiers follow each other among the recognised
ones, with few other sentences between. Everything is one projection in Spark's own
functions: no join, no shuffle, no Python.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of widely used licences and notices, by identifier. A text is cut at
#: ``;`` and ``:`` too, so each is what lies between two end marks.
SENTENCES = {
    "apache-notice": ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "apache-file": ['Licensed under the Apache License, Version 2.0 (the "License");'],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-basis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License.", "This project is licensed under the MIT License."],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-keep": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3."],
    "free-program": ["This program is free software"],
    "free-library": ["This library is free software"],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "gpl-terms-3": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "lgpl-terms-3": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl-terms-3": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "either-2": ["either version 2 of the License, or (at your option) any later version."],
    "either-2-1": ["either version 2.1 of the License, or (at your option) any later version."],
    "either-3": ["either version 3 of the License, or (at your option) any later version."],
    "gpl2-notice": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License, version 2."],
    "agpl3-notice": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3.", "Released under the GNU Affero General Public License, version 3."],
    "lgpl-see": ["See the GNU Lesser General Public License for more details."],
    "agpl-see": ["See the GNU Affero General Public License for more details."],
    "library-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "mpl-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "mpl-notice": ["Licensed under the Mozilla Public License 2.0.", "Released under the Mozilla Public License 2.0.", "This work is licensed under the Mozilla Public License 2.0."],
    "unlicense-free": ["This is free and unencumbered software released into the public domain."],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gpl-fit": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-see": ["See the GNU General Public License for more details."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under CC BY-ND 4.0."],
    "cc0": ["Licensed under CC0 1.0.", "This work is licensed under CC0 1.0."],
    "spdx": ["SPDX-License-Identifier"],
    "name-mit": ["MIT"],
    "name-apache": ["Apache-2.0"],
    "name-gpl3": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "name-bsd3": ["BSD-3-Clause"],
    "name-bsd2": ["BSD-2-Clause"],
    "name-gpl2": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "name-lgpl21": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "name-lgpl3": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "name-agpl3": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "name-mpl2": ["MPL-2.0"],
    "name-isc": ["ISC"],
    "name-unlicense": ["Unlicense"],
    "name-zlib": ["Zlib"],
    "name-boost": ["BSL-1.0"],
}
#: Ordered rules: (licence, identifiers that must follow each other).
RULES = [
    ("AGPL-3.0", ["agpl3-notice"]),
    ("AGPL-3.0", ["free-program", "agpl-terms-3"]),
    ("AGPL-3.0", ["spdx", "name-agpl3"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-file", "apache-comply"]),
    ("Apache-2.0", ["apache-copy", "apache-basis", "apache-see"]),
    ("Apache-2.0", ["spdx", "name-apache"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["spdx", "name-bsd2"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["spdx", "name-bsd3"]),
    ("BSL-1.0", ["boost-notice"]),
    ("BSL-1.0", ["spdx", "name-boost"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC0-1.0", ["cc0"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("GPL-2.0", ["free-program", "gpl-terms", "either-2"]),
    ("GPL-2.0", ["spdx", "name-gpl2"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0", ["free-program", "gpl-terms-3"]),
    ("GPL-3.0", ["free-program", "gpl-terms", "either-3"]),
    ("GPL-3.0", ["spdx", "name-gpl3"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["spdx", "name-isc"]),
    ("LGPL-2.1", ["free-library", "lgpl-terms", "either-2-1"]),
    ("LGPL-2.1", ["spdx", "name-lgpl21"]),
    ("LGPL-3.0", ["free-program", "lgpl-terms-3"]),
    ("LGPL-3.0", ["free-library", "lgpl-terms-3"]),
    ("LGPL-3.0", ["free-library", "lgpl-terms", "either-3"]),
    ("LGPL-3.0", ["spdx", "name-lgpl3"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("MIT", ["spdx", "name-mit"]),
    ("MPL-2.0", ["mpl-form", "mpl-copy"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("MPL-2.0", ["spdx", "name-mpl2"]),
    ("Unlicense", ["unlicense-free"]),
    ("Unlicense", ["spdx", "name-unlicense"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Zlib", ["spdx", "name-zlib"]),
]
#: A longer rule that replaces what a shorter one found.
REPLACES = {"BSD-3-Clause": "BSD-2-Clause"}
#: Other sentences allowed between two identifiers of a rule.
GAP = 6
#: Each known sentence except bare names has one of these words; a text without any is done.
ANCHORS = ("licens", "permission", "warrant", "redistribut", "copyright", "free software", "unencumbered", "of the mpl")
#: An end mark before white space, or a blank line, ends a sentence.
SENTENCE_END = "[.!?;:]+([\\x09-\\x0D\\x20]+|\\z)|\\n[\\x09-\\x0D\\x20]*\\n"
MARK = "\x01"


def normal_form(sentence: Column) -> Column:
    """ASCII letters and digits in lower case, single blanks between words."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def known_sentences() -> dict[str, str]:
    """Normal form of each known sentence to its identifier."""
    out = {}
    for name, sentences in SENTENCES.items():
        for sentence in sentences:
            words = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split()
            out[" ".join(words)] = name
    return out


def sequence_of(text: Column) -> Column:
    """The identifiers in order, as ``|a|b||c|``: a double bar where the gap is too wide."""
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in sorted(known_sentences().items())))
    sentences = F.split(F.regexp_replace(text, SENTENCE_END, MARK), MARK)

    def named(sentence, place):
        lines = F.split(sentence, "\n")
        parts = F.when(F.size(lines) > 1, F.concat(F.array(sentence), lines)).otherwise(lines)
        return F.transform(parts, lambda part: F.struct(place.alias("place"), F.element_at(known, normal_form(part)).alias("name")))

    found = F.filter(F.flatten(F.transform(sentences, named)), lambda x: x["name"].isNotNull())
    start = F.struct(F.lit("").alias("text"), F.lit(-1_000_000).alias("place"))
    joined = F.aggregate(
        found, start,
        lambda done, x: F.struct(
            F.concat(done["text"], F.when(x["place"] - done["place"] > GAP + 1, F.lit("||")).otherwise(F.lit("|")), x["name"]).alias("text"),
            x["place"].alias("place"),
        ),
    )["text"]
    return F.when(F.size(found) > 0, F.concat(F.substring(joined, 2, 1 << 30), F.lit("|"))).otherwise(F.lit(""))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sequence, n_sentences, licenses) of every row.

    ``sequence`` holds the recognised identifiers, ``n_sentences`` how many there are,
    ``licenses`` the sorted names of the matched licences with commas between, empty if
    none. Null and empty texts have none; rows are not merged, whatever repeats.
    """
    text = F.col(text_col)
    lowered = F.lower(text)
    anchored = F.lit(False)
    for word in ANCHORS:
        anchored = anchored | lowered.contains(word)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(F.coalesce(anchored, F.lit(False)), sequence_of(text)).otherwise(F.lit("")).alias("sequence"),
    )
    hits = [F.when(F.col("sequence").contains("|" + "|".join(names) + "|"), F.lit(licence)) for licence, names in RULES]
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))
    for longer, shorter in REPLACES.items():
        names = F.when(F.array_contains(names, longer), F.array_remove(names, shorter)).otherwise(names)
    count = F.when(F.col("sequence") == "", F.lit(0)).otherwise(F.size(F.filter(F.split("sequence", "\\|"), lambda x: x != "")))
    return rows.select(
        "doc_id", "sequence", count.cast("long").alias("n_sentences"),
        F.when(F.col("sequence") == "", F.lit("")).otherwise(F.array_join(names, ",")).alias("licenses"),
    )


def oracle_sql() -> str:
    """The same scan in SQL."""
    blank = "[\\x09-\\x0D\\x20]"
    known = ", ".join(f"('{k}', '{v}')" for k, v in sorted(known_sentences().items()))
    hits = ", ".join(f"CASE WHEN contains(sequence, '|{'|'.join(names)}|') THEN '{licence}' END" for licence, names in RULES)
    anchors = " OR ".join(f"contains(lower(text), '{w}')" for w in ANCHORS)
    return f"""
        WITH known(form, name) AS (VALUES {known}),
        cut AS (SELECT row_number() OVER () AS row, doc_id,
            CASE WHEN {anchors} THEN string_split(regexp_replace(text, '[.!?;:]+({blank}+|\\z)|\\n{blank}*\\n', chr(1), 'g'), chr(1)) END AS sentences
            FROM documents),
        sentence AS (SELECT row, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS place FROM cut),
        part AS (SELECT row, place, 0 AS line, s AS part FROM sentence
            UNION ALL SELECT row, place, generate_subscripts(string_split(s, chr(10)), 1), unnest(string_split(s, chr(10)))
            FROM sentence WHERE contains(s, chr(10))),
        found AS (SELECT row, place, line, name FROM part
            JOIN known ON form = trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g'))),
        gaps AS (SELECT *, place - lag(place) OVER (PARTITION BY row ORDER BY place, line) AS gap FROM found),
        joined AS (SELECT row, count(*) AS n,
            '|' || string_agg(CASE WHEN gap > {GAP + 1} THEN '|' ELSE '' END || name || '|', '' ORDER BY place, line) AS sequence
            FROM gaps GROUP BY row),
        named AS (SELECT row, list_sort(list_distinct([x FOR x IN [{hits}] IF x IS NOT NULL])) AS names FROM joined)
        SELECT doc_id, coalesce(sequence, '') AS sequence, coalesce(n, 0) AS n_sentences,
            coalesce(array_to_string(CASE WHEN list_contains(names, 'BSD-3-Clause')
                THEN [x FOR x IN names IF x <> 'BSD-2-Clause'] ELSE names END, ','), '') AS licenses
        FROM cut LEFT JOIN joined USING (row) LEFT JOIN named USING (row)
    """
