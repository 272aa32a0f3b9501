"""Licence recognition by sentence rules, in DataFrame expressions only.

A text is cut into sentences; each is normalised (lower case, a-z, digits and dots only, single blanks) and mapped to the
identifier of a known licence sentence, if it is one; a sentence that is none is cut at blank lines (also those with only
comment marks), which end headings, and a paragraph of it that is none is looked up line by line (headings and
one-line notices often lack a full stop).  The sequence of identifiers is then matched against the licence rules in
their order: a rule that finds its identifiers as a run in the sequence reports its licence and consumes every such run,
so that a shorter rule cannot report a part of it again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: known licence sentences, normalised, and their identifiers ---
SENTENCES = {
    "licensed under the apache license version 2.0": "ApacheTwo",
    "licensed under the apache license version 2.0 the license": "ApacheTwo",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "released under the mit license": "MitRelease",
    "licensed under the mit license": "MitRelease",
    "this project is licensed under the mit license": "MitRelease",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the software": "MitNotice",
    "this work is licensed under the gnu general public license version 3": "GplThree",
    "this work is licensed under the gnu general public license version 2": "GplTwo",
    "this program is free software": "GplFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
    "software foundation either version 3 of the license or at your option any later version": "GplThreeLater",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
    "software foundation either version 2 of the license or at your option any later version": "GplTwoLater",
    "licensed under cc by nc 4.0": "CcByNcFour",
    "licensed under cc by sa 4.0": "CcBySaFour",
    "licensed under cc by 4.0": "CcByFour",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "BsdRedistribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission": "BsdEndorse",
    "all rights reserved": "AllRights",
}

# --- fixed values: licence rules in matching order (longer runs before their parts) ---
RULES = [
    ("Apache-2.0", ["ApacheTwo", "ApacheUse", "ApacheCopy"]),
    ("GPL-3.0-or-later", ["GplFree", "GplThreeLater"]),
    ("GPL-2.0-or-later", ["GplFree", "GplTwoLater"]),
    ("MIT", ["MitRelease", "MitGrant", "MitNotice"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("BSD-3-Clause", ["BsdRedistribution", "BsdEndorse"]),
    ("Apache-2.0", ["ApacheTwo"]),
    ("MIT", ["MitRelease"]),
    ("MIT", ["MitGrant"]),
    ("GPL-3.0-only", ["GplThree"]),
    ("GPL-2.0-only", ["GplTwo"]),
    ("GPL-3.0-or-later", ["GplThreeLater"]),
    ("GPL-2.0-or-later", ["GplTwoLater"]),
    ("BSD-2-Clause", ["BsdRedistribution"]),
    ("CC-BY-NC-4.0", ["CcByNcFour"]),
    ("CC-BY-SA-4.0", ["CcBySaFour"]),
    ("CC-BY-4.0", ["CcByFour"]),
    ("All-Rights-Reserved", ["AllRights"]),
]

#: sentence ends become one control character: clause marks, and full stops before a blank or the end
SENTENCE_END = r"[;:!?]+|\.([ \t\r\n]|\z)"
MARK = "\x01"
LINE_END = r"[\r\n]+"
#: a line without letters and digits, with the line breaks around it
BLANK_LINE = r"\r?\n([^\p{L}\p{N}\r\n]*\r?\n)+|\r([^\p{L}\p{N}\r\n]*\r)+"
#: as the SQL statement has it, which does without comment marks between words and without blank lines
KEYWORD = r"(?i)licen[sc]e|permission|copyright|redistribut|free[ \t\r\n]+software|rights[ \t\r\n]+reserved"
#: every sentence of SENTENCES has one of these, so texts and sentences without any are passed over
KNOWN_WORDS = r"(?i)licen[sc]e|permission|copyright|redistribut|free[^a-zA-Z0-9.]+software|rights[^a-zA-Z0-9.]+reserved"


def gate(sentences: dict[str, str]) -> str:
    """A pattern that is found in every text with one of the ``sentences``: few words that each of them has one of."""
    if sentences is SENTENCES:
        return KNOWN_WORDS
    left, chosen = [set(s.split()) for s in sentences], []
    while left:
        words = sorted({w for s in left for w in s})
        if not words:  # an empty sentence: nothing can be passed over
            return ""
        best = max(words, key=lambda w: (sum(w in s for s in left), len(w)))
        chosen.append(best)
        left = [s for s in left if best not in s]
    return "(?i)" + "|".join(re.escape(w) for w in chosen)


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9.]+", " "))


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of a text's known sentences, in order."""
    if not sentences:
        return F.array().cast("array<string>")
    known, words = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair]), gate(sentences)

    def lookup(s: Column) -> Column:
        return F.try_element_at(known, normalised(s))

    def parts(s: Column, end: str) -> Column:
        return F.filter(F.split(s, end), lambda x: x.rlike(words))

    def first_known(s: Column, otherwise: Column) -> Column:
        return F.when(lookup(s).isNotNull(), F.array(lookup(s))).otherwise(otherwise)

    def of_paragraph(s: Column) -> Column:
        return first_known(s, F.transform(parts(s, LINE_END), lookup))

    def of_sentence(s: Column) -> Column:
        return first_known(s, F.flatten(F.transform(parts(s, BLANK_LINE), of_paragraph)))
    sentence = parts(F.regexp_replace(text, SENTENCE_END, MARK), MARK)
    found = F.filter(F.flatten(F.transform(sentence, of_sentence)), lambda x: x.isNotNull())
    return F.when(text.rlike(words), found).otherwise(F.array().cast("array<string>"))


def match_rules(ids: Column, rules=RULES) -> Column:
    """The licences of a sequence of identifiers, in the order of the rules, each once."""
    steps = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit("|" + "||".join(run) + "|").alias("run"))
                      for name, run in rules])
    start = F.struct(F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|")).alias("left"),
                     F.array().cast("array<string>").alias("found"))

    def apply(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["left"], rule["run"])
        # "#" keeps what stood around a consumed run from becoming neighbours
        return F.struct(F.when(hit, F.replace(acc["left"], rule["run"], F.lit("#"))).otherwise(acc["left"]).alias("left"),
                        F.when(hit, F.array_append(acc["found"], rule["licence"])).otherwise(acc["found"]).alias("found"))
    done = F.aggregate(steps, start, apply, lambda acc: F.array_distinct(acc["found"]))
    return F.when(F.size(ids) > 0, done).otherwise(F.array().cast("array<string>"))


def scan_licences(docs: DataFrame, *, text: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """All columns of ``docs`` and ``__sentences`` (identifiers in the order of the text) and ``__licences`` (licences in
    the order of the rules, each once).

    Known sentences that no rule consumes report nothing.  A NULL, empty or blank text has no sentences; texts are
    scanned whole, whatever their length.  Rows are handled one by one, without a shuffle: repeated rows, NULLs in other
    columns and an empty table pass through.  Further columns keep their values; their names must not begin with two
    underscores.
    """
    out = docs.withColumn("__sentences", identifiers(F.coalesce(F.col(text), F.lit("")), sentences))
    return out.withColumn("__licences", match_rules(F.col("__sentences"), rules))
