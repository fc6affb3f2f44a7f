"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences, these are normalised and looked up among known licence sentences, each of which
stands for an identifier. The identifiers of a text, in order, are then matched against ordered rules: a rule is
a sequence of identifiers that stands for a licence, longer rules come first, and what a rule has taken is not
matched again. Sentences that are not known may stand between those of a rule; known ones may not.

Everything stays in the row: one scan, no shuffle. Texts without any of the words that ``keywords`` takes from the
known sentences, at least one from each, are passed on at once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.llm.common import read

JOINED_LINES = 12  # lines over which the SQL joins a known sentence; the operator has no such limit
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Sentences of public licences and their usual notices. {name} is any name of NAMES.
FORMS = [
    "Licensed under {name}", "Released under {name}", "Distributed under {name}", "Available under {name}",
    "This work is licensed under {name}", "This project is licensed under {name}", "This software is licensed under {name}",
    "This file is licensed under {name}", "This program is licensed under {name}", "This software is released under {name}",
    "SPDX-License-Identifier: {name}",
]
NAMES = {
    "MIT": ["MIT", "the MIT License", "MIT License", "the MIT license (MIT)"],
    "Apache-2.0": ["Apache-2.0", "the Apache License, Version 2.0", "the Apache License 2.0", "Apache License, Version 2.0", "the Apache 2.0 license"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GPLv2"],
    "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GPLv3"],
    "LGPL-2.1": ["LGPL-2.1", "the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["LGPL-3.0", "the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["AGPL-3.0", "the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["MPL-2.0", "the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"],
    "BSD-2-Clause": ["BSD-2-Clause", "the BSD 2-Clause License", "the 2-clause BSD license", "the simplified BSD license"],
    "BSD-3-Clause": ["BSD-3-Clause", "the BSD 3-Clause License", "the 3-clause BSD license", "the new BSD license"],
    "ISC": ["ISC", "the ISC License"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "the Creative Commons Attribution 4.0 International License", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0", "CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"],
    "EPL-2.0": ["EPL-2.0", "the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0"],
}
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-head": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-free": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-later": "either version 2 of the License, or (at your option) any later version.",
    "gpl-no-warranty": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "mpl-head": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-head": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("Apache-2.0", ["apache-head", "apache-use", "apache-as-is", "apache-see"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl2-later", "gpl-no-warranty", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-no-warranty", "gpl-see"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl2-later"]),
    ("Apache-2.0", ["apache-head", "apache-use"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MPL-2.0", ["mpl-head", "mpl-copy"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0", ["gpl2-free"]),
    ("Apache-2.0", ["apache-head"]),
    ("MPL-2.0", ["mpl-head"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-head"]),
    ("All-rights-reserved", ["reserved"]),
]
#: The filter of the SQL. It wants one space between two words, so it misses wrapped ones, and knows no word of mpl-copy.
KEYWORDS = "licen[cs]e|permission|warrant|liable|redistribut|copyright|mozilla public|public domain|rights reserved|under (mit|isc|cc|bsd|apache|mpl|epl|gpl|lgpl|agpl|the gpl)"

STOP = "([.!?;])[ \\t\\r]+"  # ends a sentence inside a line
CLOSED = "[.!?;:][ \\t\\r]*$"  # a line that ends so isn't carried on by the next
#: What the GPL-3.0 notice says in the line of its known sentence, before it; no known sentence has "software you".
LEAD = "(?s)^.*software:[ \\t\\r]+(?=you([^a-z0-9]|$))"
MARK = "\x01"


def normal(sentence: str) -> str:
    """Lower case; everything but letters and digits is one space."""
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def known() -> dict[str, str]:
    """Identifier of each known normalised sentence."""
    out = {normal(form.format(name=name)): f"ref {licence}" for licence, names in NAMES.items() for form in FORMS for name in names}
    return out | {normal(text): name for name, text in SENTENCES.items()}


STEMS = "licen[cs]e|permission|warrant|liable|redistribut|copyright"


def keywords() -> str:
    """Pattern that is in the lowered text of every known sentence, whatever signs and line breaks are between its
    words: a stem, or else its words from "under" on, three at most, or its last three."""
    tails = set()
    for words in (s.split(" ") for s in known() if not re.search(STEMS, s)):
        at = words.index("under") if "under" in words else len(words) - 3
        tails.add("[^a-z0-9]+".join(words[at: at + 3]))
    return "|".join([STEMS, *sorted(tails)])


def rules() -> list[tuple[str, str]]:
    """Licence and pattern over the identifiers ``<id@start@stop>`` of each rule, in order; references come last."""
    every = RULES + [(name, [f"ref {name}"]) for name in NAMES]
    return [(licence, "".join(f"<{i.replace('.', '[.]')}@[0-9]+@[0-9]+>" for i in ids)) for licence, ids in every]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _units(low: Column) -> Column:
    """Normalised sentences (t) of a lowered text, and whether the next line carries each on (open)."""
    parts = F.flatten(F.transform(F.split(low, "\n"), lambda line: F.split(F.regexp_replace(line, STOP, f"$1{MARK}"), MARK)))
    return F.transform(parts, lambda p: _let(F.trim(F.regexp_replace(F.regexp_replace(p, LEAD, ""), "[^a-z0-9]+", " ")), lambda t: F.struct(
        t.alias("t"), ((t != "") & ~p.rlike(CLOSED)).alias("open"))))


def _openings() -> str:
    """Pattern of the sentences that a known sentence can start with: its first word alone, or its first two."""
    second = defaultdict(set)
    for words in (s.split(" ") for s in known()):
        second[words[0]].add(words[1])
    return "^(" + "|".join(f"{w}($| ({'|'.join(sorted(n))})($| ))" for w, n in sorted(second.items())) + ")"


def _identified(units: Column, table: Column) -> Column:
    """(start, stop, id) of the known sentences, over as many lines as carry one on. Each line of a run has a word, so
    one of n words is on n lines at most; a run longer than all known sentences ends."""
    words, size = max(len(s.split(" ")) for s in known()), max(map(len, known()))

    def at(i: Column) -> Column:
        zero = F.struct(F.lit("").alias("t"), F.lit(True).alias("open"), (i - 1).alias("stop"), F.array().cast(FOUND).alias("found"))

        def longer(run: Column, u: Column) -> Column:
            text, stop = F.concat(run["t"], F.when(run["t"] == "", "").otherwise(" "), u["t"]), run["stop"] + 1
            return F.when(run["open"], _let(text, lambda t: F.struct(
                t.alias("t"), (u["open"] & (F.length(t) < size)).alias("open"), stop.alias("stop"),
                _let(F.element_at(table, t), lambda id: F.when(id.isNull(), run["found"]).otherwise(
                    F.concat(run["found"], F.array(F.struct(i.alias("start"), stop.alias("stop"), id.alias("id")))))).alias("found")))).otherwise(run)

        return F.aggregate(F.slice(units, i, words), zero, longer, lambda run: run["found"])

    starts = F.filter(F.sequence(F.lit(1), F.size(units)), lambda i: F.element_at(units, i)["t"].rlike(_openings()))
    return F.flatten(F.transform(starts, at))


FOUND = "array<struct<start:int,stop:int,id:string>>"
MATCHES = "array<struct<licence:string,start:int,stop:int>>"


def _matched(tokens: Column) -> Column:
    """Rules in their order over the identifiers; what one has taken is closed to the others."""
    listed = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(pattern).alias("pattern")) for licence, pattern in rules()])
    zero = F.struct(tokens.alias("rest"), F.array().cast(MATCHES).alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        new = F.transform(F.regexp_extract_all(acc["rest"], rule["pattern"], F.lit(0)), lambda m: F.struct(
            rule["licence"].alias("licence"), F.regexp_extract(m, "@([0-9]+)@", 1).cast("int").alias("start"),
            F.regexp_extract(m, "@([0-9]+)>$", 1).cast("int").alias("stop")))
        return F.struct(F.regexp_replace(acc["rest"], rule["pattern"], F.lit("#")).alias("rest"), F.concat(acc["found"], new).alias("found"))

    return F.aggregate(listed, zero, step, lambda acc: F.array_sort(acc["found"], _by_place))


def _by_place(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(
        a["licence"] < b["licence"], -1).when(a["licence"] > b["licence"], 1).otherwise(0)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` replaced by sentence_ids (identifiers of the known sentences, in order) and
    licences (licence, start and stop sentence of each match, in order; sentences count from 1).

    Null, empty and other texts without known sentences have empty lists. Every row is kept, repeated ones too;
    extra columns are kept, but for those that have the name of a result. A known sentence that no rule takes appears in sentence_ids alone."""
    pairs = [F.lit(x) for pair in known().items() for x in pair]
    table = F.create_map(*pairs)
    low = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)

    def result(found: Column) -> Column:
        tokens = F.array_join(F.transform(found, lambda s: F.concat(F.lit("<"), s["id"], F.lit("@"), s["start"].cast("string"), F.lit("@"), s["stop"].cast("string"), F.lit(">"))), "")
        return F.struct(F.transform(found, lambda s: s["id"]).alias("sentence_ids"), _matched(tokens).alias("licences"))

    none = F.struct(F.array().cast("array<string>").alias("sentence_ids"), F.array().cast(MATCHES).alias("licences"))
    out = _let(low, lambda t: F.when(t.rlike(keywords()), _let(_units(t), lambda u: _let(_identified(u, table), lambda f: F.when(
        F.size(f) > 0, result(f)).otherwise(none)))).otherwise(none))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "sentence_ids", "licences")]
    return docs.select(*kept, out.alias("_scan")).select(*kept, "_scan.sentence_ids", "_scan.licences")


def op4(spark, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("sentence_ids").cast("bigint").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.size("licences").cast("bigint").alias("n_licences"),
        F.array_join(F.transform("licences", lambda m: F.concat(m["licence"], F.lit("@"), m["start"].cast("string"), F.lit("-"), m["stop"].cast("string"))), ",").alias("licences"))


def op4_sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({text(s)}, {text(i)})" for s, i in known().items())
    listed = ", ".join(f"({k}, {text(licence)}, {text(pattern)})" for k, (licence, pattern) in enumerate(rules(), 1))
    return rf"""
with recursive known(s, id) as (values {table}), rules(r, licence, pattern) as (values {listed}),
d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as low from documents),
p as (select doc_id, flatten(list_transform(string_split(low, chr(10)), lambda l: string_split(regexp_replace(l, '{STOP}', '\1' || chr(1), 'g'), chr(1)))) as u
      from d where regexp_matches(low, '{KEYWORDS}')),
q as (select doc_id, list_transform(u, lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'), ' ')) as t, u from p),
o as (select doc_id, t, list_transform(range(1, len(u) + 1), lambda i: t[i] <> '' and not regexp_matches(u[i], '{CLOSED}')) as o from q),
x as (select doc_id, i, i + m - 1 as j, id from o, unnest(range(1, len(t) + 1)) a(i), unnest(range(1, {JOINED_LINES + 1})) b(m), known
      where i + m - 1 <= len(t) and s = array_to_string(t[i:i + m - 1], ' ') and not list_contains(case when m = 1 then [] else o[i:i + m - 2] end, false)),
seq as (select doc_id, count(*) as n, string_agg(id, ',' order by i, j) as ids, string_agg('<' || id || '@' || i || '@' || j || '>', '' order by i, j) as tokens from x group by 1),
rec as (select doc_id, cast(0 as bigint) as r, tokens as rest, cast([] as varchar[]) as found from seq
        union all
        select doc_id, rec.r + 1, regexp_replace(rest, pattern, '#', 'g'), list_concat(found, list_transform(regexp_extract_all(rest, pattern), lambda m:
               licence || '@' || regexp_extract(m, '@([0-9]+)@', 1) || '-' || regexp_extract(m, '@([0-9]+)>$', 1))) from rec join rules on rules.r = rec.r + 1),
f as (select doc_id, found from rec where r = (select max(r) from rules)),
l as (select doc_id, count(*) as n, string_agg(m, ',' order by cast(regexp_extract(m, '@([0-9]+)-', 1) as bigint), m) as licences from f, unnest(found) z(m) group by 1)
select doc_id, coalesce(seq.n, 0) as n_sentences, coalesce(ids, '') as sentence_ids, coalesce(l.n, 0) as n_licences, coalesce(licences, '') as licences
from d left join seq using (doc_id) left join l using (doc_id)
"""
