"""Licence scan in DataFrame functions only: known sentences, then rules over their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (sentence id, normalised words). A sentence that holds the words, on word
# boundaries, holds that sentence; of those that begin together the longest counts. Wordings
# that mean the same share an id.
SENTENCES = (
    ("apache2-ref", "licensed under the apache license version 2 0"),
    ("apache2-or", "or the apache license version 2 0"),
    ("apache2-or", "and the apache license version 2 0"),
    ("apache2-title", "apache license version 2 0 january 2004"),
    ("apache2-may", "you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at"),
    ("apache2-asis", "distributed under the license is distributed on an as is basis"),
    ("mit-ref", "under the mit license"),
    ("mit-or", "or the mit license"),
    ("mit-or", "and the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("asis-provided", "the software is provided as is without warranty of any kind"),
    ("mit-liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose"),
    ("isc-grant", "permission to use copy modify and distribute this software for any purpose"),
    ("isc-appear", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-asis", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd-redist", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-advertise", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-asis", "this software is provided by the copyright holders and contributors as is"),
    ("bsd-asis", "this software is provided by the copyright holder and contributors as is"),
    ("bsd-asis", "this software is provided by the regents and contributors as is"),
    ("bsd-asis", "this software is provided by the author and contributors as is"),
    ("bsd-asis", "this software is provided by the author as is"),
    ("bsd-ref", "under the bsd license"),
    ("gpl3-ref", "gnu general public license version 3"),
    ("gpl2-ref", "gnu general public license version 2"),
    ("gpl-modify", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl-modify", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-modify", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gnu-v3", "either version 3 of the license"),
    ("gnu-v2", "either version 2 of the license"),
    ("gnu-v21", "either version 2 1 of the license"),
    ("gnu-only2", "version 2 of the license"),
    ("gnu-only3", "version 3 of the license"),
    ("gpl-later", "or at your option any later version"),
    ("gpl-hope", "distributed in the hope that it will be useful"),
    ("agpl3-ref", "gnu affero general public license version 3"),
    ("lgpl-ref", "gnu lesser general public license"),
    ("mpl2-ref", "subject to the terms of the mozilla public license v 2 0"),
    ("mpl2-name", "mozilla public license version 2 0"),
    ("epl2-ref", "eclipse public license v 2 0"),
    ("epl2-ref", "eclipse public license v2 0"),
    ("epl2-ref", "eclipse public license 2 0"),
    ("bsl-title", "boost software license version 1 0"),
    ("bsl-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib-asis", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib-origin", "the origin of this software must not be misrepresented"),
    ("cc0-title", "cc0 1 0 universal"),
    ("cc0-ref", "dedicated to the public domain under cc0"),
    ("ccby-ref", "under cc by 4 0"),
    ("ccbysa-ref", "under cc by sa 4 0"),
    ("ccbync-ref", "under cc by nc 4 0"),
    ("ccbyncnd-ref", "under cc by nc nd 4 0"),
    ("ccby-name", "creative commons attribution 4 0 international license"),
    ("ccbync-name", "creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
    ("spdx-apache2", "spdx license identifier apache 2 0"),
    ("spdx-mit", "spdx license identifier mit"),
    ("spdx-bsd3", "spdx license identifier bsd 3 clause"),
    ("spdx-gpl3", "spdx license identifier gpl 3 0"),
    ("spdx-gpl2", "spdx license identifier gpl 2 0"),
    ("spdx-mpl2", "spdx license identifier mpl 2 0"),
    ("spdx-bsd2", "spdx license identifier bsd 2 clause"),
    ("spdx-isc", "spdx license identifier isc"),
    ("spdx-zlib", "spdx license identifier zlib"),
    ("spdx-bsl", "spdx license identifier bsl 1 0"),
    ("spdx-cc0", "spdx license identifier cc0 1 0"),
    ("spdx-unlicense", "spdx license identifier unlicense"),
    ("spdx-lgpl21", "spdx license identifier lgpl 2 1"),
    ("spdx-lgpl3", "spdx license identifier lgpl 3 0"),
    ("spdx-agpl3", "spdx license identifier agpl 3 0"),
    ("spdx-epl2", "spdx license identifier epl 2 0"),
)
#: (licence, family, sentence ids in order, other known sentences allowed between two of them).
RULES = (
    ("Apache-2.0", "permissive", ("apache2-ref",), 0),
    ("Apache-2.0", "permissive", ("mit-ref", "apache2-or"), 0),
    ("Apache-2.0", "permissive", ("bsd-ref", "apache2-or"), 0),
    ("Apache-2.0", "permissive", ("spdx-apache2",), 0),
    ("Apache-2.0", "permissive", ("apache2-may", "apache2-copy", "apache2-asis"), 2),
    ("MIT", "permissive", ("mit-ref",), 0),
    ("MIT", "permissive", ("apache2-ref", "mit-or"), 0),
    ("MIT", "permissive", ("bsd-ref", "mit-or"), 0),
    ("MIT", "permissive", ("spdx-mit",), 0),
    ("MIT", "permissive", ("mit-grant", "mit-notice", "asis-provided"), 2),
    ("ISC", "permissive", ("isc-grant", "asis-provided"), 2),
    ("ISC", "permissive", ("isc-grant", "isc-appear", "isc-asis"), 0),
    ("ISC", "permissive", ("spdx-isc",), 0),
    ("0BSD", "permissive", ("isc-grant", "isc-asis"), 0),
    ("Zlib", "permissive", ("zlib-asis", "zlib-grant", "zlib-origin"), 1),
    ("Zlib", "permissive", ("spdx-zlib",), 0),
    ("BSL-1.0", "permissive", ("bsl-grant", "asis-provided"), 2),
    ("BSL-1.0", "permissive", ("bsl-title",), 0),
    ("BSL-1.0", "permissive", ("spdx-bsl",), 0),
    ("Apache-2.0", "permissive", ("apache2-title",), 0),
    ("BSD", "permissive", ("bsd-ref",), 0),
    ("BSD-3-Clause", "permissive", ("spdx-bsd3",), 0),
    ("BSD-2-Clause", "permissive", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-asis"), 0),
    ("BSD-3-Clause", "permissive", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis"), 0),
    ("BSD-2-Clause", "permissive", ("spdx-bsd2",), 0),
    ("BSD-4-Clause", "permissive", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse", "bsd-asis"), 0),
    ("GPL-3.0", "copyleft", ("gpl3-ref",), 0),
    ("GPL-3.0", "copyleft", ("spdx-gpl3",), 0),
    ("GPL-2.0", "copyleft", ("gpl2-ref",), 0),
    ("GPL-2.0", "copyleft", ("spdx-gpl2",), 0),
    ("GPL", "copyleft", ("gpl-modify", "gpl-hope"), 2),
    ("GPL-2.0-or-later", "copyleft", ("gpl-modify", "gnu-v2", "gpl-later"), 0),
    ("GPL-3.0-or-later", "copyleft", ("gpl-modify", "gnu-v3", "gpl-later"), 0),
    ("GPL-2.0", "copyleft", ("gpl-modify", "gnu-only2"), 0),
    ("GPL-3.0", "copyleft", ("gpl-modify", "gnu-only3"), 0),
    ("AGPL-3.0", "copyleft", ("agpl3-ref",), 0),
    ("AGPL-3.0", "copyleft", ("spdx-agpl3",), 0),
    ("AGPL-3.0-or-later", "copyleft", ("agpl-modify", "gnu-v3", "gpl-later"), 0),
    ("LGPL", "copyleft", ("lgpl-ref",), 0),
    ("LGPL-2.1", "copyleft", ("spdx-lgpl21",), 0),
    ("LGPL-3.0", "copyleft", ("spdx-lgpl3",), 0),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl-modify", "gnu-v21", "gpl-later"), 0),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl-modify", "gnu-v3", "gpl-later"), 0),
    ("MPL-2.0", "copyleft", ("mpl2-ref",), 0),
    ("MPL-2.0", "copyleft", ("mpl2-name",), 0),
    ("MPL-2.0", "copyleft", ("spdx-mpl2",), 0),
    ("EPL-2.0", "copyleft", ("epl2-ref",), 0),
    ("EPL-2.0", "copyleft", ("spdx-epl2",), 0),
    ("CC0-1.0", "permissive", ("cc0-ref",), 0),
    ("CC0-1.0", "permissive", ("cc0-title",), 0),
    ("CC0-1.0", "permissive", ("spdx-cc0",), 0),
    ("Unlicense", "permissive", ("spdx-unlicense",), 0),
    ("Unlicense", "permissive", ("unlicense",), 0),
    ("CC-BY-4.0", "permissive", ("ccby-ref",), 0),
    ("CC-BY-4.0", "permissive", ("ccby-name",), 0),
    ("CC-BY-SA-4.0", "copyleft", ("ccbysa-ref",), 0),
    ("CC-BY-NC-4.0", "restricted", ("ccbync-ref",), 0),
    ("CC-BY-NC-4.0", "restricted", ("ccbync-name",), 0),
    ("CC-BY-NC-ND-4.0", "restricted", ("ccbyncnd-ref",), 0),
)
#: What holds only where no rule fits: a licence that grants something stands beside this sentence as a rule.
ELSE = ("All-Rights-Reserved", "restricted", ("reserved",), 0)
FAMILIES = ("restricted", "copyleft", "permissive")

# The patterns below mean the same to Java's expressions and to DuckDB's.
#: The start of a line with what stands before its first word: blank space, comment marks of signs or letters.
LEAD = r"(^|\n)[^A-Za-z0-9\n]*((?i:rem|dnl)[ \t]+)?"
#: The stop of an abbreviated version ends no sentence.
VERSION = r"(\b[vV])\.[ \t\n]*([0-9])"
#: Where a sentence ends: a line without a word, or a stop that blank space or the end follows; single line ends do not.
END = r"\n\n+|[.;!?]+([ \t\n]+|\z)"
#: A sentence is looked up only if it holds one of these, which every known sentence does.
HINT = r"(?i)licen[sc]e|permission|copyright|redistribut|warranty|under cc|cc0|spdx|mozilla|eclipse|public domain|later version|may be used to endorse|will be useful|provided (by|as)|rights reserved|advertising materials|of this software"
#: Words that take back a known sentence which begins right after them or up to two words later.
NOT = r"(?:not|never|isn  t|no  longer)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hint() -> str:
    return HINT.replace(" ", "[^a-z0-9]+")


def phrase_pattern() -> str:
    """A known sentence, or one that is taken back, among words that two blanks part: so that neighbours need not share one."""
    known = "|".join(p.replace(" ", "  ") for _, p in sorted(SENTENCES, key=lambda x: (-len(x[1]), x[1])))
    return f" ({NOT}  (?:[a-z0-9]+  ){{0,2}}(?:{known})|{known}) "


def sentence_ids(text: Column) -> Column:
    """array<string>: the identifiers of the known sentences of ``text``, in their order, repeats included.

    A sentence may run over wrapped and commented lines and hold several known ones that do
    not overlap; of those that begin together the longest counts.  One that a negation
    stands before is none.
    """
    lines = F.regexp_replace(F.regexp_replace(F.translate(text, "\r", ""), LEAD, "\n"), VERSION, "$1 $2")
    held = F.filter(F.split(lines, END, -1), lambda s: s.rlike(hint()))
    words = F.transform(held, lambda s: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^a-z0-9]+", "  ")), F.lit(" ")))
    known = F.flatten(F.transform(words, lambda s: F.regexp_extract_all(s, F.lit(phrase_pattern()), F.lit(1))))
    name = F.create_map(*[F.lit(x) for n, p in SENTENCES for x in (p.replace(" ", "  "), n)])
    return F.filter(F.transform(known, lambda p: F.try_element_at(name, p)), lambda i: i.isNotNull())


def rule_pattern(ids: tuple[str, ...], gap: int) -> str:
    """The regular expression of one ordered rule over ``|id|id|``."""
    between = r"\|" + (rf"([^|]+\|){{0,{gap}}}" if gap else "")
    return r"\|" + between.join(ids) + r"\|"


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, n_sentences, licences, family): one row for each row of ``docs``.

    ``sentence_ids`` joins the known sentences in order by commas; ``licences`` joins the
    licences of the rules that fit, sorted and distinct, or that of ELSE where none does; ``family`` is the strictest family
    among them (restricted, copyleft, permissive), or ``none``.  Null text counts as empty.
    A row is judged by its own text: repeated rows and null ids stay as they are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentence_ids(text).alias("ids"))
    rows = rows.withColumn("seq", F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|")))
    fits = [(name, family, F.col("seq").rlike(rule_pattern(ids, gap))) for name, family, ids, gap in RULES]
    named = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(fit, F.lit(name)) for name, _, fit in fits]), lambda x: x.isNotNull())))
    last = F.col("seq").rlike(rule_pattern(*ELSE[2:]))
    family = F.when(last, ELSE[1]).otherwise("none")
    for kind in reversed(FAMILIES):
        any_of = F.lit(False)
        for _, own, fit in fits:
            if own == kind:
                any_of = any_of | fit
        family = F.when(any_of, F.lit(kind)).otherwise(family)
    return rows.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.size("ids").cast("long").alias("n_sentences"), F.when((F.size(named) == 0) & last, ELSE[0]).otherwise(F.array_join(named, ",")).alias("licences"), family.alias("family"))


def oracle() -> str:
    """DuckDB SQL for :func:`scanned` over the table documents."""
    q = lambda s: s.replace("'", "''")
    names = "CASE p " + " ".join(f"WHEN '{p.replace(' ', '  ')}' THEN '{n}'" for n, p in SENTENCES) + " END"
    licences = ", ".join(f"CASE WHEN regexp_matches(seq, '{q(rule_pattern(ids, gap))}') THEN '{name}' END" for name, _, ids, gap in RULES)
    families = " ".join(f"WHEN {' OR '.join(f"regexp_matches(seq, '{q(rule_pattern(ids, gap))}')" for _, own, ids, gap in RULES if own == kind)} THEN '{kind}'" for kind in FAMILIES)
    last = f"regexp_matches(seq, '{q(rule_pattern(*ELSE[2:]))}')"
    return f"""
WITH lines AS (
  SELECT doc_id, regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13), ''), '{LEAD}', chr(10), 'g'), '{VERSION}', '\\1 \\2', 'g') AS t FROM documents),
held AS (
  SELECT doc_id, list_transform(list_filter(regexp_split_to_array(t, '{END}'), lambda s: regexp_matches(s, '{q(hint())}')),
    lambda s: ' ' || trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', '  ', 'g')) || ' ') AS words FROM lines),
found AS (SELECT doc_id, flatten(list_transform(words, lambda s: regexp_extract_all(s, '{phrase_pattern()}', 1))) AS known FROM held),
named AS (SELECT doc_id, list_filter(list_transform(known, lambda p: {names}), lambda i: i IS NOT NULL) AS ids FROM found),
rows AS (SELECT doc_id, ids, '|' || array_to_string(ids, '|') || '|' AS seq FROM named)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, CAST(len(ids) AS BIGINT) AS n_sentences,
  coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter([{licences}], lambda x: x IS NOT NULL))), ','), ''), CASE WHEN {last} THEN '{ELSE[0]}' ELSE '' END) AS licences,
  CASE {families} WHEN {last} THEN '{ELSE[1]}' ELSE 'none' END AS family
FROM rows"""
