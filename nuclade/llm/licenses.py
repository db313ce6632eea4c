"""License scans by sentence rules, in DataFrame functions only.

A text is normalised with its line breaks, sentence ends and blank lines marked.
A known sentence is found from one mark to another, over line breaks but neither
over a sentence end nor a blank line, and mapped to its identifiers; these, in
order, are matched against ordered rules, where a rule that matches uses its
sentences up, so that longer rules come first.

Scale: everything happens within a row. There is no shuffle, no join and no
broadcast; the known sentences are a literal map of fixed size.

The SQL knows ``SENTENCES`` and ``RULES`` within one line only. ``FORMS`` and
``MORE_RULES`` hold what the standard headers have besides.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised, by identifier.
SENTENCES = {
    "apacheLic": "licensed under the apache license version 2.0",
    "apacheComply": "you may not use this file except in compliance with the license",
    "apacheCopy": "you may obtain a copy of the license at",
    "mitRelease": "released under the mit license",
    "mitLic": "licensed under the mit license",
    "mitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mitNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asIs": "the software is provided as is without warranty of any kind",
    "gplWork3": "this work is licensed under the gnu general public license version 3",
    "gplWork2": "this work is licensed under the gnu general public license version 2",
    "gplTerms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gplVersion2": "version 2 of the license",
    "gplVersion3": "version 3 of the license",
    "orLater": "or at your option any later version",
    "lgplWork": "this library is licensed under the gnu lesser general public license version 2.1",
    "bsdRedist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsdEndorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mplTerms": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "ccByNc4": "licensed under cc by nc 4.0",
    "ccBy4": "licensed under cc by 4.0",
    "ccBySa4": "licensed under cc by sa 4.0",
    "allRights": "all rights reserved",
}
#: Rules in order of trial, as license and sequence of sentences.
RULES = [
    ("Apache-2.0", ["apacheLic", "apacheComply", "apacheCopy"]),
    ("MIT", ["mitRelease", "mitGrant", "mitNotice", "asIs"]),
    ("MIT", ["mitGrant", "mitNotice", "asIs"]),
    ("MIT", ["mitGrant", "mitNotice"]),
    ("BSD-3-Clause", ["bsdRedist", "bsdSource", "bsdBinary", "bsdEndorse"]),
    ("BSD-2-Clause", ["bsdRedist", "bsdSource", "bsdBinary"]),
    ("GPL-2.0-or-later", ["gplTerms", "gplVersion2", "orLater"]),
    ("GPL-3.0-or-later", ["gplTerms", "gplVersion3", "orLater"]),
    ("GPL-3.0-or-later", ["gplWork3", "orLater"]),
    ("GPL-2.0-only", ["gplTerms", "gplVersion2"]),
    ("GPL-3.0-only", ["gplTerms", "gplVersion3"]),
    ("GPL-3.0-only", ["gplWork3"]),
    ("GPL-2.0-only", ["gplWork2"]),
    ("LGPL-2.1-only", ["lgplWork"]),
    ("Apache-2.0", ["apacheLic"]),
    ("MIT", ["mitRelease"]),
    ("MIT", ["mitLic"]),
    ("MPL-2.0", ["mplTerms"]),
    ("CC-BY-NC-4.0", ["ccByNc4"]),
    ("CC-BY-SA-4.0", ["ccBySa4"]),
    ("CC-BY-4.0", ["ccBy4"]),
    ("LicenseRef-reserved", ["allRights"]),
]

GPL = "you can redistribute it and or modify it under the terms of the gnu general public license"
LGPL = "you can redistribute it and or modify it under the terms of the gnu lesser general public license"
AGPL = "you can redistribute it and or modify it under the terms of the gnu affero general public license"
FSF = "as published by the free software foundation"
LATER = "or at your option any later version"
#: Other forms of sentences, normalised, and the sentences they stand for; ``|`` is a sentence end within.
FORMS = {
    "licensed under the apache license version 2.0 the license": ["apacheLic"],
    "the asf licenses this file to you under the apache license version 2.0 the license": ["apacheLic"],
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": ["asIs"],
    f"{GPL} version 2 {FSF}": ["gplTerms", "gplVersion2"],
    f"{GPL} version 3 {FSF}": ["gplTerms", "gplVersion3"],
    f"{LGPL} {FSF}": ["lgplTerms"],
    f"{AGPL} {FSF}": ["agplTerms"],
    f"{AGPL} version 3 {FSF}": ["agplTerms", "gplVersion3"],
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": ["iscGrant"],
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": ["iscGrant"],
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": ["iscAsIs"],
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at": ["eplTerms2"],
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0": ["eplTerms2"],
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0": ["eplTerms2"],
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at": ["eplTerms1"],
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0": ["eplTerms1"],
    "this software is provided as is without any express or implied warranty": ["zlibAsIs"],
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": ["zlibGrant"],
    "this is free and unencumbered software released into the public domain": ["unlicense"],
    "distributed under the boost software license version 1.0": ["boost"],
    "boost software license version 1.0 august 17th 2003": ["boost"],
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": ["cc0"],
    "version 2.1 of the license": ["lgplVersion21"],
    "this source code form is subject to the terms of the mozilla public license v|2.0": ["mplTerms"],
    "this work is licensed under cc by nc 4.0": ["ccByNc4"],
    "this work is licensed under cc by sa 4.0": ["ccBySa4"],
    "this work is licensed under cc by 4.0": ["ccBy4"],
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": ["ccByNc4"],
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": ["ccBySa4"],
    "this work is licensed under a creative commons attribution 4.0 international license": ["ccBy4"],
    f"this work is licensed under the gnu general public license version 3 {LATER}": ["gplWork3", "orLater"],
}
for _start, _terms in (("", []), (f"{GPL} {FSF} ", ["gplTerms"]), (f"{LGPL} {FSF} ", ["lgplTerms"]), (f"{AGPL} {FSF} ", ["agplTerms"])):
    for _number, _version in (("2", "gplVersion2"), ("2.1", "lgplVersion21"), ("3", "gplVersion3")):
        FORMS[f"{_start}either version {_number} of the license {LATER}"] = [*_terms, _version, "orLater"]
        if _terms:
            FORMS[f"{_start}version {_number} of the license"] = [*_terms, _version]
#: Rules tried after ``RULES``.
MORE_RULES = [
    ("LGPL-2.1-or-later", ["lgplTerms", "lgplVersion21", "orLater"]),
    ("LGPL-3.0-or-later", ["lgplTerms", "gplVersion3", "orLater"]),
    ("LGPL-2.1-only", ["lgplTerms", "lgplVersion21"]),
    ("LGPL-3.0-only", ["lgplTerms", "gplVersion3"]),
    ("AGPL-3.0-or-later", ["agplTerms", "gplVersion3", "orLater"]),
    ("AGPL-3.0-only", ["agplTerms", "gplVersion3"]),
    ("ISC", ["iscGrant", "iscAsIs"]),
    ("ISC", ["iscGrant"]),
    ("EPL-2.0", ["eplTerms2"]),
    ("EPL-1.0", ["eplTerms1"]),
    ("Zlib", ["zlibAsIs", "zlibGrant"]),
    ("Zlib", ["zlibGrant"]),
    ("Unlicense", ["unlicense"]),
    ("BSL-1.0", ["boost"]),
    ("CC0-1.0", ["cc0"]),
]

ENDS = r"([.!?;:])[ \t\r\n\f]+"
OTHER = r"[^a-z0-9.]+"
EDGES = r"^[ .]+|[ .]+$"
#: What a line starts with before its first letter or digit, comment marks too.
MARKS = r"(^|\n)[^a-z0-9\n]+"


def _pattern(ids: list[str]) -> str:
    return "".join(f"<{x}>" for x in ids)


def _marked(text: Column) -> Column:
    """Normalised text, a newline where a line breaks and ``|`` where a sentence ends, at blank lines and both ends."""
    text = F.translate(F.lower(F.coalesce(text, F.lit(""))), "|", "_")
    text = F.regexp_replace(F.regexp_replace(text, MARKS, "$1"), ENDS, "$1|")
    text = F.regexp_replace(F.regexp_replace(text, r"\n\n+", "|"), r"[^a-z0-9.\n|]+", " ")
    return F.regexp_replace(F.concat(F.lit("|"), text, F.lit("|")), r"[ .]*([\n|])[ .]*", "$1")


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_sentences, sequence, licenses, n_unused)`` of each row of ``docs(doc_id, text)``.

    ``n_sentences`` counts those that are known, of a form that stands for
    several each, ``sequence`` lists them in order as ``<id>``, ``licenses`` the
    licenses whose rules matched, sorted and joined by commas, ``n_unused`` the
    known sentences that no rule used. A text that is null, empty or without
    known sentences has zero, two empty strings and zero. Other columns are
    ignored; repeated rows are each scanned.
    """
    forms = {text: [name] for name, text in SENTENCES.items()} | FORMS
    known = F.create_map(*chain.from_iterable((F.lit(text), F.lit(_pattern(names))) for text, names in forms.items()))
    # The longest form first, as one may start another.
    one = "|".join(re.escape(x).replace("\\ ", "[ \\n]").replace("\\|", "\\|+") for x in sorted(forms, key=len, reverse=True))
    found = F.regexp_extract_all(_marked(F.col("text")), F.lit(rf"[\n|]({one})(?=[\n|])"), F.lit(1))
    ids = F.transform(found, lambda x: F.element_at(known, F.regexp_replace(F.translate(x, "\n", " "), r"\|+", "|")))
    rows = docs.select("doc_id", F.array_join(ids, "").alias("sequence"))
    rows = rows.select("doc_id", "sequence", (F.length("sequence") - F.length(F.replace("sequence", F.lit("<")))).alias("n"))
    left, hits = F.col("sequence"), []
    for name, rule in [*RULES, *MORE_RULES]:
        hits.append(F.when(F.contains(left, F.lit(_pattern(rule))), F.lit(name)))
        left = F.replace(left, F.lit(_pattern(rule)), F.lit("|"))
    # Most rows have no known sentence; the rules are tried only on the others.
    some = F.col("n") > 0
    licenses = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))), ",")
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_sentences"),
        "sequence",
        F.when(some, licenses).otherwise("").alias("licenses"),
        F.when(some, F.length(left) - F.length(F.replace(left, F.lit("<"), F.lit("")))).otherwise(0).cast("long").alias("n_unused"),
    )


def oracle() -> str:
    cases = "\n        ".join(f"WHEN '{text}' THEN '<{name}>'" for name, text in SENTENCES.items())
    left, hits = "sequence", []
    steps = []
    for k, (name, rule) in enumerate(RULES):
        hits.append(f"CASE WHEN contains(s{k}, '{_pattern(rule)}') THEN '{name}' END")
        steps.append(f"t{k + 1} AS (SELECT *, replace(s{k}, '{_pattern(rule)}', '|') AS s{k + 1} FROM t{k})")
    n = len(RULES)
    chained = ",\n".join(steps)
    return f"""
WITH lines AS (SELECT doc_id, string_split(regexp_replace(lower(coalesce(text, '')), '{ENDS}', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
normal AS (SELECT doc_id, list_transform(parts, lambda x: regexp_replace(regexp_replace(x, '{OTHER}', ' ', 'g'), '{EDGES}', '', 'g')) AS parts FROM lines),
known AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: CASE x
        {cases} END), lambda x: x IS NOT NULL) AS ids FROM normal),
t0 AS (SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, '') AS sequence, array_to_string(ids, '') AS s0 FROM known),
{chained}
SELECT doc_id, n_sentences, sequence,
    array_to_string(list_sort(list_distinct(list_filter([{", ".join(hits)}], lambda x: x IS NOT NULL))), ',') AS licenses,
    CAST(length(s{n}) - length(replace(s{n}, '<', '')) AS BIGINT) AS n_unused
FROM t{n}
"""
