"""Licence scans by sentence rules.

Each sentence of a text is normalised and mapped to the identifier of a known licence sentence, of a short notice in its
usual phrasings (``This file is licensed under the terms of the ..``), or of a sentence with a name in it.  The
identifiers of a text, in their order, are then matched against ordered rules: a rule is a sequence of identifiers that
has to be found without another known sentence in between, and it uses them up, so the sentences of a longer licence do
not count for a shorter one as well.  Unknown sentences do not matter, so names, years and page furniture in a licence
text do no harm.

Licence texts are hard-wrapped and stand in comments, so a known sentence may go over line ends and comment marks, but
not over blank lines or sentence ends.  It has to begin behind a line end, a sentence end or at the start of the text,
and to end at such a place, so a one-line notice between lines without full stops is found as well.

All in one projection: the dictionary and the rules are constants.  A text without any of the dictionary's trigger words
cannot hold a known sentence (checked when this module is loaded) and is not split at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import put, text_of

# Sentences of public licences and of customary notices, in normal form (lower case, one blank between
# runs of letters and digits).
SENTENCES: dict[str, int] = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": 1,
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": 2,
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": 3,
    "you may not use this file except in compliance with the license": 11,
    "you may obtain a copy of the license at": 12,
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": 13,
    "see the license for the specific language governing permissions and limitations under the license": 14,
    "this program is free software": 20,
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": 21,
    "either version 3 of the license or at your option any later version": 22,
    "either version 2 of the license or at your option any later version": 23,
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": 27,
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": 28,
    "this program is distributed in the hope that it will be useful but without any warranty": 24,
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": 30,
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": 31,
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": 32,
    "this is free and unencumbered software released into the public domain": 50,
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": 51,
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": 51,
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": 51,
    "this source code form is subject to the terms of the mozilla public license v 2 0": 60,
    "this source code form is subject to the terms of the mozilla public license v": 60,  # cut behind "v."
    "mozilla public license version 2 0": 61,
    "apache license version 2 0 january 2004": 15,
    "this library is free software": 29,
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": 70,
    "either version 2 1 of the license or at your option any later version": 71,
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": 72,
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": 73,
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": 74,
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": 75,
    "all rights reserved": 90,
}

# Names of licences in short notices, in normal form, behind a phrase of LEAD.
NOTICES: dict[str, int] = {
    "mit license": 4, "apache license version 2 0": 10, "apache license 2 0": 10, "apache 2 0 license": 10, "apache license v2 0": 10,
    "gnu general public license version 3": 25, "gnu general public license v3 0": 25, "gnu gpl version 3": 25, "gpl version 3": 25, "gpl v3": 25, "gplv3": 25,
    "gnu general public license version 2": 26, "gnu general public license v2 0": 26, "gnu gpl version 2": 26, "gpl version 2": 26, "gpl v2": 26, "gplv2": 26,
    "bsd 3 clause license": 34, "3 clause bsd license": 34, "bsd 2 clause license": 35, "2 clause bsd license": 35, "isc license": 52,
    "cc by nc 4 0": 40, "cc by 4 0": 41, "cc by sa 4 0": 42, "creative commons attribution noncommercial 4 0 international license": 40,
    "creative commons attribution 4 0 international license": 41, "creative commons attribution sharealike 4 0 international license": 42,
    "mozilla public license version 2 0": 62, "mozilla public license 2 0": 62, "mpl 2 0": 62,
    "gnu lesser general public license version 3": 76, "lgpl version 3": 76, "lgplv3": 76, "gnu affero general public license version 3": 77, "agpl version 3": 77, "agplv3": 77,
}
LEAD = (
    r"(?:(?:this|the|all|it)(?: [a-z0-9]+){0,4} (?:is|are) )?(?:made )?(?:licensed|released|distributed|published|available|provided|offered)"
    r"(?: to you)? under (?:the )?(?:terms of )?(?:the |an? )?"
)
TAIL = "(?: the license)?"
#: Sentences in which a name stands, which is up to eight words.
NAMED: dict[str, int] = {
    r"neither the name of (?:[a-z0-9]+ ){1,8}nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission": 33,
}

#: Rules (licence, identifiers in order), the more telling ones first; what a rule matches is used up.
RULES: tuple[tuple[str, tuple[int, ...]], ...] = (
    ("MIT", (1, 2, 3)),
    ("MIT", (1, 2)),
    ("MIT", (4,)),
    ("Apache-2.0", (10, 11, 12, 13)),
    ("Apache-2.0", (10,)),
    ("Apache-2.0", (15,)),
    ("GPL-3.0-or-later", (20, 21, 22)),
    ("GPL-2.0-or-later", (20, 21, 23)),
    ("GPL-3.0-or-later", (20, 27)),
    ("GPL-2.0-or-later", (20, 28)),
    ("GPL-3.0", (25,)),
    ("GPL-2.0", (26,)),
    ("LGPL-2.1-or-later", (29, 70, 71)),
    ("LGPL-2.1-or-later", (29, 72)),
    ("LGPL-3.0-or-later", (29, 70, 22)),
    ("LGPL-3.0-or-later", (29, 73)),
    ("LGPL-3.0", (76,)),
    ("AGPL-3.0-or-later", (20, 74, 22)),
    ("AGPL-3.0-or-later", (20, 75)),
    ("AGPL-3.0", (77,)),
    ("BSD-3-Clause", (30, 31, 32, 33)),
    ("BSD-2-Clause", (30, 31, 32)),
    ("BSD-3-Clause", (34,)),
    ("BSD-2-Clause", (35,)),
    ("CC-BY-NC-4.0", (40,)),
    ("CC-BY-4.0", (41,)),
    ("CC-BY-SA-4.0", (42,)),
    ("Unlicense", (50,)),
    ("ISC", (51,)),
    ("ISC", (52,)),
    ("MPL-2.0", (60,)),
    ("MPL-2.0", (61,)),
    ("MPL-2.0", (62,)),
)
#: Where no rule matched at all: customary with licences, too, it tells something only by itself.
LAST_RULE = ("Proprietary", 90)

KINDS = {"GPL": "copyleft", "AGPL": "copyleft", "LGPL": "weak-copyleft", "CC-BY-NC": "non-commercial", "CC-BY-SA": "share-alike", "MPL": "weak-copyleft", "Proprietary": "proprietary"}
#: Comment marks made of letters, in front of a line.
REMARKS = "dnl|rem"
TRIGGERS = r"licen[cs]e|under cc by|under (?:the )?(?:gnu|a?l?gpl|mpl)|copyright|warrant|permission|redistribut|free software|either version|public domain|all rights reserved"

assert all(re.search(TRIGGERS, s) for s in [*SENTENCES, *NAMED, *("under " + n for n in NOTICES)]), "a known sentence without a trigger word would be missed"


def kind_of(license_name: str) -> str:
    return next((kind for start, kind in KINDS.items() if license_name.startswith(start)), "permissive")


# Marks in a normalised text: a sentence end, and the edges of a known sentence.
STOP, EDGE = "\x01", "\x02"
BOUNDARY = f"[\n{STOP}]"
#: All that is known, the longest first.
FORMS = [*sorted(SENTENCES, key=len, reverse=True), *NAMED, LEAD + "(?:" + "|".join(sorted(NOTICES, key=len, reverse=True)) + ")" + TAIL]
#: A known sentence from boundary to boundary; its words may be on several lines.
KNOWN = f"(?<={BOUNDARY})(?:" + "|".join(FORMS).replace(" ", "[ \n]") + f")(?={BOUNDARY})"
GATE = TRIGGERS.replace(" ", f" (?:(?:{REMARKS}) )?")


def marked(text: Column) -> Column:
    """Normal form with boundaries: line ends stay, ``. ! ? ; :`` with white space behind is one ``STOP``; known sentences
    stand between ``EDGE`` marks.  A line without letters or digits is empty, so two line ends part what it parts."""
    ends = F.regexp_replace(F.translate(text, STOP, "|"), r"([.!?;:])[\x20\x09-\x0D]+", "$1" + STOP)
    words = F.lower(F.regexp_replace(ends, f"[^A-Za-z0-9\n{STOP}]+", " "))
    tight = F.regexp_replace(F.concat(F.lit(STOP), words, F.lit(STOP)), f" *({BOUNDARY}) *", "$1")
    bare = F.regexp_replace(tight, f"(?<={BOUNDARY})(?:{REMARKS})(?: |(?={BOUNDARY}))", "")
    return F.regexp_replace(bare, KNOWN, f"{EDGE}$0{EDGE}")


def identifiers(text: Column) -> Column:
    """For each sentence of the text, in order, its identifier or null.  A known sentence is one, whatever its lines."""
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    notice = lambda x: F.regexp_replace(F.regexp_replace(x, f"^{LEAD}", ""), f"{TAIL}$", "")
    others = lambda x: [F.when(x.rlike(f"^{form}$"), F.lit(k)) for form, k in NAMED.items()]
    known = lambda x: F.coalesce(F.element_at(table(SENTENCES), x), F.element_at(table(NOTICES), notice(x)), *others(x))
    between = lambda x: F.array_repeat(F.lit(None).cast("int"), F.regexp_count(x, F.lit(BOUNDARY)) - 1)
    part = lambda x, i: F.when(i % 2 == 1, F.array(known(F.translate(x, "\n", " ")))).otherwise(between(x))
    return F.flatten(F.transform(F.split(marked(text), EDGE, -1), part))


def pattern(ids: tuple[int, ...]) -> str:
    return "".join(f"<{k}>" for k in ids)


def names_of(ids: Column) -> Column:
    """The names of the rules that match, sorted; each rule in turn uses up the identifiers it matches."""
    row = F.array_join(F.transform(ids, lambda k: F.concat(F.lit("<"), k.cast("string"), F.lit(">"))), "")
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern(ids_)).alias("ids")) for name, ids_ in RULES])
    start = F.struct(row.alias("left"), F.array().cast("array<string>").alias("names"))

    def use(state: Column, rule: Column) -> Column:
        names = F.when(state["left"].contains(rule["ids"]), F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"])
        return F.struct(F.replace(state["left"], rule["ids"], F.lit("|")).alias("left"), names.alias("names"))

    found = F.array_sort(F.array_distinct(F.aggregate(rules, start, use)["names"]))
    last = F.when(F.array_contains(ids, LAST_RULE[1]), F.array(F.lit(LAST_RULE[0]))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).otherwise(last)


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All input columns and rows plus ``license_ids`` (known identifiers in order), ``license_spans`` (sentence number
    and identifier), ``licenses`` (names, sorted) and ``license_kinds``.

    A text without known sentences, a null and an empty text have empty arrays.  Repeated rows get equal results.  Very
    long texts are scanned whole.  An empty table gives an empty result.  Input columns named like an output are
    replaced.
    """
    text = text_of(text_col)
    tagged = F.transform(identifiers(text), lambda k, i: F.struct(i.alias("sentence"), k.alias("id")))
    spans = F.filter(tagged, lambda s: s["id"].isNotNull())
    none = F.array().cast("array<struct<sentence:int,id:int>>")
    rows = put(docs, {"license_spans": F.when(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")).rlike(GATE), spans).otherwise(none)})
    rows = put(rows, {"license_ids": F.transform("license_spans", lambda s: s["id"])})
    rows = put(rows, {"licenses": F.when(F.size("license_ids") > 0, names_of(F.col("license_ids"))).otherwise(F.array().cast("array<string>"))})
    names = sorted({name for name, _ in RULES} | {LAST_RULE[0]})
    kinds = F.create_map(*[F.lit(x) for name in names for x in (name, kind_of(name))])
    return put(rows, {"license_kinds": F.array_sort(F.array_distinct(F.transform("licenses", lambda n: F.element_at(kinds, n))))})


def scan_sql() -> str:
    """The same over the view ``documents`` for DuckDB, but for known sentences that go over a line end: it cuts there."""
    table = lambda pairs: "map {" + ", ".join(f"'{s}': {k}" for s, k in pairs.items()) + "}"
    notice = f"regexp_replace(regexp_replace(x, '^{LEAD}', ''), '{TAIL}$', '')"
    others = " ".join(f"WHEN regexp_full_match(x, '{form}') THEN {k}" for form, k in NAMED.items())
    known = f"coalesce({table(SENTENCES)}[x], CASE WHEN regexp_matches(x, '^{LEAD}') THEN {table(NOTICES)}[{notice}] {others} END)"
    left, found = "j", []
    for name, ids in RULES:
        found.append(f"CASE WHEN contains({left}, '{pattern(ids)}') THEN '{name}' END")
        left = f"replace({left}, '{pattern(ids)}', '|')"
    return f"""
    WITH s AS (SELECT doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10)),
                      lambda x: lower(trim(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g')))) AS n FROM documents),
    k AS (SELECT doc_id, list_filter(list_transform(n, lambda x: {known}), lambda x: x IS NOT NULL) AS ids FROM s),
    j AS (SELECT doc_id, ids, len(ids)::INTEGER AS n_known, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS j FROM k),
    r AS (SELECT *, list_sort(list_distinct(list_filter([{", ".join(found)}], lambda x: x IS NOT NULL))) AS found FROM j)
    SELECT doc_id, n_known, coalesce(array_to_string(ids, ','), '') AS license_ids,
           CASE WHEN len(found) > 0 THEN array_to_string(found, ',') WHEN list_contains(ids, {LAST_RULE[1]}) THEN '{LAST_RULE[0]}' ELSE '' END AS licenses FROM r"""
