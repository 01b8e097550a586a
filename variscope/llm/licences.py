"""Licence scans by sentence rules.

A text is normalised to words and cut into sentences: at sentence ends and at lines without a word, not
at single line breaks, so that sentences wrapped at any width or set in comments are whole. Sentences that
hold a known licence sentence get its identifier; the identifiers of a document, in order, are
matched against ordered rules. A rule that matches takes its identifiers away, so a
later, shorter rule can't claim them again. All of it is one projection: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Identifier and normalised words of known licence sentences.
SENTENCES = [
    ("Apache2Ref", "licensed under the apache license version 2 0"),
    ("ApacheCopy", "you may obtain a copy of the license at"),
    ("ApacheAsIs", "distributed on an as is basis"),
    ("MITRef", "released under the mit license"),
    ("MITRef", "licensed under the mit license"),
    ("MITGrant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("MITNotice", "the above copyright notice and this permission notice shall be included"),
    ("GPLv3Ref", "licensed under the gnu general public license version 3"),
    ("GPLv2Ref", "licensed under the gnu general public license version 2"),
    ("GPLTerms", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("LGPLRef", "under the terms of the gnu lesser general public license"),
    ("BSDSource", "redistributions of source code must retain the above copyright notice"),
    ("BSDBinary", "redistributions in binary form must reproduce the above copyright notice"),
    ("BSDName", "neither the name of"),
    ("MPL2Ref", "subject to the terms of the mozilla public license v 2 0"),
    ("CCBYNC4", "licensed under cc by nc 4 0"),
    ("CCBYSA4", "licensed under cc by sa 4 0"),
    ("CCBY4", "licensed under cc by 4 0"),
    ("PublicDomain", "released into the public domain"),
    ("AsIs", "provided as is without warranty of any kind"),
    ("AllRights", "all rights reserved"),
]
#: Licence and the identifiers that make it out, most telling first.
RULES = [
    ("Apache-2.0", ["Apache2Ref", "ApacheCopy", "ApacheAsIs"]),
    ("MIT", ["MITGrant", "MITNotice", "AsIs"]),
    ("BSD-3-Clause", ["BSDSource", "BSDBinary", "BSDName"]),
    ("BSD-2-Clause", ["BSDSource", "BSDBinary"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("Apache-2.0", ["Apache2Ref", "ApacheCopy"]),
    ("Apache-2.0", ["Apache2Ref"]),
    ("MIT", ["MITRef"]),
    ("MIT", ["MITGrant"]),
    ("GPL-3.0", ["GPLv3Ref"]),
    ("GPL-2.0", ["GPLv2Ref"]),
    ("GPL", ["GPLTerms"]),
    ("LGPL", ["LGPLRef"]),
    ("MPL-2.0", ["MPL2Ref"]),
    ("CC-BY-NC-4.0", ["CCBYNC4"]),
    ("CC-BY-SA-4.0", ["CCBYSA4"]),
    ("CC-BY-4.0", ["CCBY4"]),
    ("Public-Domain", ["PublicDomain"]),
    ("Proprietary", ["AllRights"]),
]
#: Words of which each known sentence has one; other sentences are not looked at closer.
TELLING = "licen|copyright|rights reserved|permission|redistribut|warranty|public domain|basis|neither"

#: A word of each alternative of TELLING; a text without any of them has no known sentence.
HINTS = "|".join(words.split()[-1] for words in TELLING.split("|"))
#: Ends of sentences, but for the points of abbreviations.
ENDS = r"(?<!\b(?:v|ver|vers|cf|co|inc|ltd|corp|e\.g|i\.e))[.!?][ \t\r\n]+"
#: Words that begin a line of comment; marks such as ``*``, ``#`` and ``//`` go with all others.
LEADERS = r"(?m)^ ?(?:dnl|rem|c)(?= |$) ?"


def identifiers(text: Column) -> Column:
    """Identifiers of a text's licence sentences, in order; empty for null or empty texts.

    A known sentence counts for the line in which it begins, there once.
    """
    plain = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_replace(F.regexp_replace(plain, ENDS, "\n\n"), "[^a-z0-9\n]+", " ")
    # Two readings of equal length: line breaks kept, and as spaces.
    lines = F.transform(F.split(words, r"\n[ \n]*\n"), lambda s: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(s, LEADERS, ""), " ?\n ?", "\n")), F.lit(" ")))
    both = F.filter(F.transform(lines, lambda s: F.struct(s.alias("lines"), F.translate(s, "\n", " ").alias("words"))), lambda s: s["words"].rlike(TELLING))

    def places(s: Column, i: str, known: str, n: int) -> Column:
        """(line, n, identifier) of each line of ``s`` in which the known sentence begins."""
        gaps = F.split(s["words"], f"(?<= ){known}(?= )", -1)
        before = F.transform(F.slice(gaps, 1, F.size(gaps) - 1), lambda _, k: F.aggregate(F.slice(gaps, 1, k + 1), F.lit(0), lambda a, g: a + F.length(g)) + k * len(known))
        breaks = lambda at: at - F.length(F.translate(F.left(s["lines"], at), "\n", ""))
        found = F.transform(before, lambda at: F.struct(breaks(at).alias("line"), F.lit(n).alias("n"), F.lit(i).alias("id")))
        return F.when(F.contains(s["words"], F.lit(f" {known} ")), found)

    def known(s: Column) -> Column:
        found = F.filter(F.array(*[places(s, i, w, n) for n, (i, w) in enumerate(SENTENCES)]), lambda x: x.isNotNull())
        return F.transform(F.array_sort(F.array_distinct(F.flatten(found))), lambda x: x["id"])

    return F.when(plain.rlike(HINTS), F.flatten(F.transform(both, known))).otherwise(F.array().cast("array<string>"))


def scan_licences(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``licence_ids`` and ``licences``, both arrays.

    ``licences`` lists each rule that matched once, in the order of the rules. A line in which several known
    sentences begin gives them in the order of the list.
    """
    left = F.concat(F.lit(","), F.array_join("licence_ids", ",,"), F.lit(","))
    found = []
    for name, ids in RULES:
        sought = F.lit("," + ",,".join(ids) + ",")
        found.append(F.when(F.contains(left, sought), F.lit(name)))
        left = F.replace(left, sought, F.lit(""))
    return df.withColumn("licence_ids", identifiers(F.col(text))).withColumn(
        "licences", F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())))


def licence_sql() -> str:
    """The scan of ``documents`` as a DuckDB statement, which cuts at every line break: equal where no known sentence is wrapped."""
    known = ", ".join(f"case when contains(s, ' {words} ') then '{i}' end" for i, words in SENTENCES)
    left, cases, steps = "seq0", [], []
    for n, (name, ids) in enumerate(RULES):
        sought = "'," + ",,".join(ids) + ",'"
        cases.append(f"case when contains(seq{n}, {sought}) then '{name}' end")
        steps.append(f"replace(seq{n}, {sought}, '') as seq{n + 1}")
    return f"""
with cut as (select doc_id, [' ' || trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) || ' ' for s in
    string_split(regexp_replace(lower(coalesce(text, '')), '([.!?])[ \\t\\r]+', '\\1\n', 'g'), '\n') if regexp_matches(s, '{TELLING}')] as sentences
  from documents),
ids as (select doc_id, flatten([[i for i in [{known}] if i is not null] for s in sentences]) as ids from cut),
left0 as (select doc_id, ids, ',' || coalesce(array_to_string(ids, ',,'), '') || ',' as seq0, {", ".join(steps)} from ids),
found as (select doc_id, ids, [x for x in [{", ".join(cases)}] if x is not null] as names from left0)
select doc_id, coalesce(array_to_string(ids, ','), '') as licence_ids,
  coalesce(array_to_string([x for x, i in names if i = list_position(names, x)], ','), '') as licences from found"""
