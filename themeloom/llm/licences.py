"""License scans: sentences become known identifiers, identifier sequences are matched against ordered rules.

A text is cut into sentences natively, each normalised sentence is looked up in a bounded literal table, and the
sequence of identifiers, one letter per sentence, is matched against rules tried in table order at each place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of widely used licences in normalised form (lower case, letters and digits only).
SENTENCES = {
    "apache-ref": ["licensed under the apache license version 2 0", "released under the apache license version 2 0",
                   "this project is licensed under the apache license 2 0",
                   "licensed under the apache license version 2 0 the license"],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "apache-asis": ["unless required by applicable law or agreed to in writing software distributed under the license is "
                    "distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit-ref": ["released under the mit license", "licensed under the mit license",
                "this project is licensed under the mit license", "distributed under the mit license"],
    "mit-title": ["mit license", "the mit license", "the mit license mit"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and "
                  "associated documentation files the software to deal in the software without restriction including "
                  "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                  "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                  "the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or "
                   "substantial portions of the software"],
    "gpl3-ref": ["this work is licensed under the gnu general public license version 3",
                 "licensed under the gnu general public license version 3",
                 "released under the gnu general public license version 3"],
    "gpl2-ref": ["this work is licensed under the gnu general public license version 2",
                 "licensed under the gnu general public license version 2"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu "
                 "general public license as published by the free software foundation either version 3 of the license or "
                 "at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even "
                 "the implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl-ref": ["licensed under the gnu lesser general public license version 3",
                 "this work is licensed under the gnu lesser general public license version 3"],
    "agpl-ref": ["licensed under the gnu affero general public license version 3",
                 "this work is licensed under the gnu affero general public license version 3"],
    "bsd3-ref": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license"],
    "bsd2-ref": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted "
                  "provided that the following conditions are met"],
    "mpl-ref": ["licensed under the mozilla public license version 2 0",
                "this source code form is subject to the terms of the mozilla public license v 2 0"],
    "isc-ref": ["licensed under the isc license", "released under the isc license"],
    "cc-by-ref": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0",
                  "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-ref": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"],
    "cc-by-nc-ref": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"],
    "cc-by-nd-ref": ["licensed under cc by nd 4 0", "this work is licensed under cc by nd 4 0"],
    "cc0-ref": ["licensed under cc0 1 0", "released under cc0 1 0"],
    "rights": ["all rights reserved"],
}

# Ordered rules. The first that matches at a place wins and takes its sentences.
RULES = (
    ("Apache-2.0", ("apache-ref", "apache-comply", "apache-copy", "apache-asis")),
    ("Apache-2.0", ("apache-ref", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-ref",)),
    ("MIT", ("mit-title", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-ref",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-2.0", ("gpl2-ref",)),
    ("LGPL-3.0", ("lgpl-ref",)),
    ("AGPL-3.0", ("agpl-ref",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("BSD", ("bsd-grant",)),
    ("MPL-2.0", ("mpl-ref",)),
    ("ISC", ("isc-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("proprietary", ("rights",)),
)

SENTENCE_END = r"\n|(?<=[.!?;:])[ \t\r\f\x0B]+"
NOT_ALNUM = r"[^\p{L}\p{N}]+"
UNKNOWN = "."
GAP = 1  # unknown sentences allowed between two of one rule


def _letters(names: list[str]) -> dict[str, str]:
    return {name: chr(0x100 + k) for k, name in enumerate(names)}


def sentence_codes(text: Column, sentences: dict[str, list[str]] = SENTENCES) -> Column:
    """One letter per sentence of the text: the identifier's, or '.' for a sentence that is not known."""
    letters = _letters(list(sentences))
    known = F.create_map(*[F.lit(x) for name, forms in sentences.items() for s in forms for x in (s, letters[name])])
    longest = max(len(s) for forms in sentences.values() for s in forms) * 2
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: F.trim(s) != "")

    def code(sentence):
        normal = F.trim(F.regexp_replace(F.lower(sentence), NOT_ALNUM, " "))
        return F.when(F.length(sentence) > longest, F.lit(UNKNOWN)).otherwise(F.coalesce(F.element_at(known, normal), F.lit(UNKNOWN)))

    return F.array_join(F.transform(pieces, code), "")


def scan(docs: DataFrame, text: str = "text", sentences: dict[str, list[str]] = SENTENCES, rules=RULES) -> DataFrame:
    """Adds n_sentences, n_known, n_matches, first_sentence (long), matches (array of licence and n_sentences, in
    text order) and licences (distinct names in alphabetical order, joined by commas).

    first_sentence counts from 0 and is null without a match; licences is '' then. Null, empty and blank texts
    have no sentences. Repeated rows give equal results; clashing columns are replaced. The sentence table and the
    rules are literals of the plan, so no join or shuffle takes place. A rule's sentences may have GAP unknown
    sentences between them, which count as part of the match.
    """
    added = ("n_sentences", "n_known", "n_matches", "first_sentence", "matches", "licences")
    letters = _letters(list(sentences))
    gap = f"\\{UNKNOWN}{{0,{GAP}}}"
    patterns = [(licence, gap.join(letters[s] for s in sequence)) for licence, sequence in rules]
    either = F.lit("(" + "|".join(p for _, p in patterns) + ")")

    def named(m):
        (licence, pattern), *rest = patterns
        value = F.when(F.regexp_like(m, F.lit(f"^(?:{pattern})$")), licence)
        for licence, pattern in rest:  # the first rule that holds wins
            value = value.when(F.regexp_like(m, F.lit(f"^(?:{pattern})$")), licence)
        return value

    kept = [docs[c] for c in docs.columns if c not in added]
    coded = docs.select(*kept, sentence_codes(docs[text], sentences).alias("_l_codes"))
    found = coded.withColumn("matches", F.transform(
        F.regexp_extract_all("_l_codes", either, 1),
        lambda m: F.struct(named(m).alias("licence"), F.length(m).cast("long").alias("n_sentences")),
    ))
    first = F.regexp_instr(F.col("_l_codes"), either).cast("long")
    return found.select(
        *[F.col(c) for c in coded.columns if c != "_l_codes"],
        F.length("_l_codes").cast("long").alias("n_sentences"),
        F.length(F.replace(F.col("_l_codes"), F.lit(UNKNOWN), F.lit(""))).cast("long").alias("n_known"),
        F.size("matches").cast("long").alias("n_matches"),
        F.when(first > 0, first - 1).alias("first_sentence"),
        "matches",
        F.array_join(F.array_sort(F.array_distinct(F.col("matches.licence"))), ",").alias("licences"),
    )
