"""License scans by sentence rules, in built-in functions only.

Each sentence of a text is normalised and mapped to the identifier of a known license sentence; the
sequence of identifiers is then matched against ordered rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu"
_BY = "general public license as published by the free software foundation either version"
_LATER = "of the license or at your option any later version"
_HOPE = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"

#: Sentences and titles of well-known license texts and notices, in normal form. A * stands for up to OWNER characters, sentence ends included.
SENTENCES = {
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "gpl2_free": f"this program {_FREE} {_BY} 2 {_LATER}",
    "gpl3_free": f"this program {_FREE} {_BY} 3 {_LATER}",
    "gpl2_kernel": f"this program {_FREE} general public license version 2 as published by the free software foundation",
    "gpl2_only": f"this program {_FREE} general public license as published by the free software foundation version 2 of the license",
    "lgpl21_free": f"this library {_FREE} lesser {_BY} 2 1 {_LATER}",
    "lgpl3_free": f"this library {_FREE} lesser {_BY} 3 {_LATER}",
    "agpl3_free": f"this program {_FREE} affero {_BY} 3 {_LATER}",
    "program_hope": f"this program {_HOPE}",
    "library_hope": f"this library {_HOPE}",
    "mpl2_form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2_copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2_copy_safe": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "bsd_redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0_waive": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "title_mit": "the mit license mit",
    "title_apache2": "apache license version 2 0 january 2004",
    "title_gpl2": "gnu general public license version 2 june 1991",
    "title_gpl3": "gnu general public license version 3 29 june 2007",
    "title_lgpl21": "gnu lesser general public license version 2 1 february 1999",
    "title_lgpl3": "gnu lesser general public license version 3 29 june 2007",
    "title_agpl3": "gnu affero general public license version 3 19 november 2007",
    "title_boost": "boost software license version 1 0 august 17th 2003",
    "title_epl2": "eclipse public license v 2 0",
    "title_artistic2": "the artistic license 2 0",
}
OWNER = 160

#: Fixed values: (license, kind, names in normal form). A sentence that ends in "released under the <name>" or the like says so.
NAMES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "permissive", ("mit license", "mit")),
    ("Apache-2.0", "permissive", ("apache license version 2 0", "apache license version 2 0 the license", "apache license 2 0", "apache 2 0 license", "apache 2 0")),
    ("GPL-2.0", "copyleft", ("gnu general public license version 2", "gnu general public license version 2 or later", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later")),
    ("GPL-3.0", "copyleft", ("gnu general public license version 3", "gnu general public license version 3 or later", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later")),
    ("LGPL-2.1", "copyleft", ("gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1 or later", "gnu lgpl version 2 1", "lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later")),
    ("LGPL-3.0", "copyleft", ("gnu lesser general public license version 3", "gnu lesser general public license version 3 or later", "gnu lgpl version 3", "lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later")),
    ("AGPL-3.0", "copyleft", ("gnu affero general public license version 3", "gnu affero general public license version 3 or later", "gnu agpl version 3", "agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later")),
    ("MPL-2.0", "copyleft", ("mozilla public license 2 0", "mozilla public license version 2 0", "mpl 2 0")),
    ("BSD-2-Clause", "permissive", ("bsd 2 clause license", "2 clause bsd license", "bsd 2 clause")),
    ("BSD-3-Clause", "permissive", ("bsd 3 clause license", "3 clause bsd license", "bsd 3 clause")),
    ("ISC", "permissive", ("isc license", "isc")),
    ("BSL-1.0", "permissive", ("boost software license version 1 0", "boost software license 1 0", "bsl 1 0")),
    ("Zlib", "permissive", ("zlib license", "zlib")),
    ("Unlicense", "permissive", ("unlicense",)),
    ("EPL-2.0", "copyleft", ("eclipse public license 2 0", "eclipse public license v 2 0", "eclipse public license version 2 0", "epl 2 0")),
    ("EUPL-1.2", "copyleft", ("european union public licence version 1 2", "european union public licence 1 2", "eupl version 1 2", "eupl version 1 2 or later", "eupl v1 2", "eupl 1 2", "eupl 1 2 or later")),
    ("Artistic-2.0", "copyleft", ("artistic license 2 0", "artistic license version 2 0", "artistic 2 0")),
    ("CC0-1.0", "permissive", ("cc0 1 0 universal", "cc0 1 0")),
    ("CC-BY-4.0", "permissive", ("creative commons attribution 4 0 international license", "cc by 4 0")),
    ("CC-BY-SA-4.0", "copyleft", ("creative commons attribution sharealike 4 0 international license", "cc by sa 4 0")),
    ("CC-BY-NC-4.0", "non-commercial", ("creative commons attribution noncommercial 4 0 international license", "cc by nc 4 0")),
)
#: What stands before a name.
LEADS = ("released under", "licensed under", "distributed under", "available under", "published under", "spdx license identifier")
ARTICLES = ("the", "a", "the terms of the", "either", "either the")
#: What turns the clause behind it into its opposite.
NEGATIONS = ("not", "never", "no longer", "isn t", "aren t", "wasn t")
#: What stands behind a name where no sentence ends.
TAIL = " which is "


def name_id(name: str) -> str:
    return f"name_{name.lower().replace('-', '_').replace('.', '_')}"


#: (license, kind, identifiers in the order in which they must follow each other among the known sentences).
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "permissive", ("mit_grant", "mit_notice", "as_is")),
    ("Apache-2.0", "permissive", ("name_apache_2_0", "apache_use", "apache_copy")),
    ("GPL-2.0", "copyleft", ("gpl2_free", "program_hope")),
    ("GPL-2.0", "copyleft", ("gpl2_kernel",)),
    ("GPL-2.0", "copyleft", ("gpl2_only",)),
    ("GPL-3.0", "copyleft", ("gpl3_free", "program_hope")),
    ("LGPL-2.1", "copyleft", ("lgpl21_free", "library_hope")),
    ("LGPL-3.0", "copyleft", ("lgpl3_free", "library_hope")),
    ("AGPL-3.0", "copyleft", ("agpl3_free", "program_hope")),
    ("MPL-2.0", "copyleft", ("mpl2_form", "mpl2_copy")),
    ("MPL-2.0", "copyleft", ("mpl2_form", "mpl2_copy_safe")),
    ("BSD-3-Clause", "permissive", ("bsd_redistribute", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", "permissive", ("bsd_redistribute", "bsd_source", "bsd_binary")),
    ("ISC", "permissive", ("isc_grant",)),
    ("Zlib", "permissive", ("zlib_as_is", "zlib_grant")),
    ("Unlicense", "permissive", ("unlicense",)),
    ("CC0-1.0", "permissive", ("cc0_waive",)),
    ("MIT", "permissive", ("title_mit",)),
    ("Apache-2.0", "permissive", ("title_apache2",)),
    ("GPL-2.0", "copyleft", ("title_gpl2",)),
    ("GPL-3.0", "copyleft", ("title_gpl3",)),
    ("LGPL-2.1", "copyleft", ("title_lgpl21",)),
    ("LGPL-3.0", "copyleft", ("title_lgpl3",)),
    ("AGPL-3.0", "copyleft", ("title_agpl3",)),
    ("BSL-1.0", "permissive", ("title_boost",)),
    ("BSL-1.0", "permissive", ("boost_grant",)),
    ("EPL-2.0", "copyleft", ("title_epl2",)),
    ("Artistic-2.0", "copyleft", ("title_artistic2",)),
    *((name, kind, (name_id(name),)) for name, kind, _ in NAMES),
)

#: A sentence ends at a line feed, or at . ! ? ; : before white space or the end. A known sentence may
#: also run over line feeds, brackets, ; and : (SOFT), as wrapped notices do, but not over . ! ? or a blank line (HARD).
HARD = r"[.!?](?=[\x20\x09-\x0D]|\z)|\n[\x20\x09\x0B-\x0D]*(?=\n)"
SOFT = r"[\n()]|[;:](?=[\x20\x09-\x0D]|\z)"
SENTENCE_END = r"\n|[.!?;:](?=[\x20\x09-\x0D]|\z)"


def marked_form(text: Column) -> Column:
    """The normal form of a whole text, with | where a sentence must end and ~ where one may."""
    text = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ|~", "abcdefghijklmnopqrstuvwxyz  ")
    for pattern, mark in ((HARD, "|"), (SOFT, "~"), ("[^a-z0-9|~]+", " "), (r"[ ~]*\|[ |~]*", "|"), (" ?~[ ~]*", "~")):
        text = F.regexp_replace(text, pattern, mark)
    return F.concat(F.lit("|"), F.trim(text), F.lit("|"))


def _longest(texts, gap: str) -> str:
    """An alternation, the longest first, with `gap` between words."""
    return "|".join(t.replace(" ", gap) for t in sorted(texts, key=lambda t: (-len(t), t))).replace(f"{gap}*{gap}", f"[ ~|]+[a-z0-9][a-z0-9 ~|]{{0,{OWNER}}}?[ ~|]+")


def _every(names) -> list[str]:
    return [n for _, _, ns in names for n in ns]


def _clause(names, gap: str) -> str:
    """A lead, perhaps an article, and names joined by and, or, with an exception perhaps; a negation before them belongs to it."""
    article, name = f"(?:(?:{_longest(ARTICLES, gap)}){gap})?", f"(?:{_longest(_every(names), gap)})"
    exception = f"(?:{gap}with(?:{gap}[a-z0-9]+){{1,6}})?"
    return f"(?:(?:{_longest(NEGATIONS, gap)}){gap})?(?:{_longest(LEADS, gap)}){gap}{article}{name}{exception}(?:{gap}(?:and|or){gap}{article}{name}{exception})*"


def _lead() -> str:
    return f"^(?:{_longest(LEADS, ' ')}) (?:(?:{_longest(ARTICLES, ' ')}) )?"


def _names_in(names) -> str:
    """The names of a clause without its lead, one by one, as group 1."""
    return f"({_longest(_every(names), ' ')})(?: with .*?(?: and | or |$)| and | or |$)"


def scan_licenses(docs: DataFrame, sentences=SENTENCES, names=NAMES, rules=RULES) -> DataFrame:
    """doc_id, n_sentences, sentence_ids (in text order), licenses (sorted) and kind of every row.

    A rule matches where its identifiers stand next to each other in the sequence of known sentences;
    unknown sentences between them don't count. A known sentence starts and ends where a sentence may,
    and may be wrapped over lines (n_sentences counts every line and part by itself). A sentence whose
    end names licenses ("This project is released under the MIT License.", "SPDX-License-Identifier: MIT
    OR Apache-2.0") counts as these names, one after another, unless a negation (NEGATIONS) stands before
    the clause; exceptions behind "with" are passed over. A three-clause text also holds the rule of the two-clause one;
    only the longer is given. kind is the strictest of the licenses found (non-commercial, copyleft,
    permissive), or none. Null and empty texts have no sentences, empty tables no rows. Rows that repeat are scanned each;
    columns other than doc_id and text are not read.
    """
    known = F.create_map(*[F.lit(x) for k, s in sentences.items() if "*" not in s for x in (s, k)])
    named = F.create_map(*[F.lit(x) for k, _, ns in names for n in ns for x in (n, name_id(k))])
    # Only texts that hold the first two words of a known sentence or lead are put in marked form.
    first: dict[str, set[str]] = {}
    for one in (*sentences.values(), *LEADS):
        first.setdefault(*one.split()[:1], set()).add(one.split()[1])
    first_words = "|".join(f"{w}[^a-z0-9]+(?:{'|'.join(sorted(ws))})" for w, ws in sorted(first.items()))
    text = whole_text(F.col("text"))
    likely = F.when(F.rlike(text, F.lit(f"(?i)(?<![a-z0-9])(?:{first_words})(?![a-z0-9])")), text).otherwise("")
    gap = "[ ~]"
    spans = F.regexp_extract_all(marked_form(likely), F.lit(f"(?<=[|~])(?:{_longest(sentences.values(), gap)})(?=[|~])|(?<=[|~ ]){_clause(names, gap)}(?=[|~]|{TAIL})"), F.lit(0))
    plain = F.transform(spans, lambda s: F.translate(s, "~", " "))
    against = F.lit(f"^(?:{_longest(NEGATIONS, ' ')}) ")

    def identified(s: Column) -> Column:
        one = F.try_element_at(known, s)
        for k, t in sentences.items():
            if "*" in t:
                one = F.when(s.startswith(t.split(" *")[0]) & s.endswith(t.split("* ")[1]), F.lit(k)).otherwise(one)
        many = F.regexp_extract_all(F.regexp_replace(s, F.lit(_lead()), F.lit("")), F.lit(_names_in(names)), F.lit(1))
        return F.when(one.isNotNull(), F.array(one)).otherwise(F.transform(many, lambda n: F.try_element_at(named, n)))

    ids = F.flatten(F.transform(F.filter(plain, lambda s: ~F.rlike(s, against)), identified))
    parts = F.filter(F.split(text, SENTENCE_END), lambda s: F.trim(s) != "")
    found = docs.select("doc_id", F.size(parts).cast("long").alias("n_sentences"), ids.alias("sentence_ids"))
    # A text has few known sentences, most have none: one pass tells which rules can match at all.
    line = F.concat(F.lit("|"), F.array_join("sentence_ids", "|"), F.lit("|"))
    hit = lambda r: line.contains("|" + "|".join(r[2]) + "|")
    every = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(hit(r), F.lit(r[0])) for r in rules]))))
    licenses = F.when(F.size("sentence_ids") == 0, F.array().cast("array<string>")).otherwise(F.when(F.array_contains(every, "BSD-3-Clause"), F.array_remove(every, "BSD-2-Clause")).otherwise(every))
    kind = F.lit("none")
    for level in ("permissive", "copyleft", "non-commercial"):
        names_of = sorted({r[0] for r in rules if r[1] == level})
        kind = F.when(F.arrays_overlap("licenses", F.array(*[F.lit(n) for n in names_of])), F.lit(level)).otherwise(kind)
    return found.select("doc_id", "n_sentences", "sentence_ids", licenses.alias("licenses")).select("*", kind.alias("kind"))


def oracle_sql(sentences=SENTENCES, names=NAMES, rules=RULES) -> str:
    """The same in SQL without look-around: marks are doubled, so that each sentence takes its own."""
    known = " ".join(f"WHEN s LIKE '{s.replace('*', '%')}' THEN ['{k}']" for k, s in sentences.items())
    of_name = " ".join(f"WHEN '{n}' THEN '{name_id(k)}'" for k, _, ns in names for n in ns)
    hit = lambda r: f"contains(line, '|{'|'.join(r[2])}|')"
    found = ", ".join(f"CASE WHEN {' OR '.join(hit(r) for r in rules if r[0] == n)} THEN '{n}' END" for n in sorted({r[0] for r in rules}))
    kinds = " ".join(f"WHEN list_has_any(found, [{', '.join(repr(n) for n in sorted({r[0] for r in rules if r[1] == k}))}]) THEN '{k}'" for k in ("non-commercial", "copyleft", "permissive"))
    gap, ws = "(?: |~~)", "[\\x20\\x09-\\x0D]"
    marked = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ|~', 'abcdefghijklmnopqrstuvwxyz  ')"
    for pattern, mark in ((f"[.!?]({ws}|$)", "|\\1"), ("\\n[\\x20\\x09\\x0B-\\x0D]*\\n", "|\\n"), (f"[;:]({ws}|$)", "~\\1"), ("[\\n()]", "~"), ("[^a-z0-9|~]+", " "), ("[ ~]*\\|[ |~]*", "|"), (" ?~[ ~]*", "~"), ("~", "~~")):
        marked = f"regexp_replace({marked}, '{pattern}', {chr(39) + mark + chr(39) if mark != '|' + chr(92) + 'n' else chr(39) + '|' + chr(39) + ' || chr(10)'}, 'g')"
    marked = f"replace('|' || trim({marked}) || '|', '|', '||')"
    return f"""
    WITH parts AS (
      SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, '') || ' ', '[.!?;:]([\\x20\\x09-\\x0D])', chr(10) || '\\1', 'g'), chr(10)), lambda s: trim(s) <> '') AS parts, {marked} AS marked
      FROM documents),
    spans AS (
      SELECT doc_id, len(parts)::BIGINT AS n_sentences,
             list_transform(regexp_extract_all(marked, '[|~](?:{_longest(sentences.values(), gap)})[|~]|[|~ ]{_clause(names, gap)}(?:[|~]|{TAIL})'), lambda s: trim(replace(translate(s, '|', ' '), '~', ' '))) AS spans
      FROM parts),
    ids AS (
      SELECT doc_id, n_sentences,
             flatten(list_transform(list_filter(list_transform(spans, lambda s: regexp_replace(regexp_replace(s, ' +', ' ', 'g'), '{TAIL.rstrip()}$', '')), lambda s: NOT regexp_matches(s, '^(?:{_longest(NEGATIONS, ' ')}) ')),
               lambda s: CASE {known} ELSE list_transform(regexp_extract_all(regexp_replace(s, '{_lead()}', ''), '{_names_in(names)}', 1), lambda n: CASE n {of_name} END) END)) AS ids
      FROM spans),
    lines AS (SELECT doc_id, n_sentences, array_to_string(ids, '|') AS sentence_ids, '|' || array_to_string(ids, '|') || '|' AS line FROM ids),
    every AS (SELECT *, list_filter([{found}], lambda x: x IS NOT NULL) AS every FROM lines),
    held AS (SELECT *, CASE WHEN list_contains(every, 'BSD-3-Clause') THEN list_filter(every, lambda x: x <> 'BSD-2-Clause') ELSE every END AS found FROM every)
    SELECT doc_id, n_sentences, sentence_ids, array_to_string(found, ',') AS licenses, CASE {kinds} ELSE 'none' END AS kind
    FROM held"""
