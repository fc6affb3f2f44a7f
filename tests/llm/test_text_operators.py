"""Licence scan, decontamination, exact duplicates, sharding and WARC against plain Python."""

import collections
import gzip
import hashlib
import io
import random
import re
import textwrap
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contentflow.llm import decontaminate, exact_dedup, license_rules, sharding, warc
from contentflow.llm.common import text_bytes, word_spans

DOCS = "doc_id long, text string, uid int, shard string, n_words string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def docs_frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those the operators use."""
    rows = [(i if ids is None else ids[k], t, k % 3, "x" if k % 2 else None, None) for k, (i, t) in enumerate(enumerate(texts))]
    return spark.createDataFrame(rows, DOCS)


def test_word_spans():
    texts = ["", "Ab c-9é", None, "xy", "  ", "Z"]
    data, off = text_bytes(pa.array(texts))
    low, s, e, before = word_spans(data, off)
    found = [low[a:b].tobytes().decode() for a, b in zip(s, e)]
    assert [found[a:b] for a, b in zip(before[:-1], before[1:])] == [words(t) for t in texts]


# ---- decontamination -------------------------------------------------------------------------


def brute_hits(text, items):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        k = min(13, len(iw))
        grams = {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)} if iw else set()
        at = [i for i in range(len(w) - k + 1) if tuple(w[i:i + k]) in grams] if iw else []
        if at:
            names.add(str(name))
            hit |= {p for i in at for p in range(i, i + k)}
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_CONTEXTS", 0)
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["é", "ünd"]
    item = lambda n: " ".join(rnd.choices(vocab, k=n))
    items = [(1, item(30)), (2, item(13)), (3, item(14)), (4, item(7)), (5, item(2)), (6, ""), (7, None), (8, item(60)), (None, item(20))]
    texts = [None, "", "...", "W1"]
    for _ in range(60):
        part = rnd.choice(items)[1] or ""
        cut = part.split()[rnd.randrange(3):rnd.choice([None, -1, 15])]
        texts.append(", ".join(item(rnd.randrange(0, 30)).split() + [c.upper() for c in cut] + item(rnd.randrange(0, 30)).split()))
    texts += [texts[10], texts[10], " ".join([items[0][1]] * 400)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [(n if n is not None else None, t) for n, t in items]
    got = decontaminate.hits(docs_frame(spark, texts).withColumnRenamed("n_words", "extra"), bench)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts) and got.columns[:4] == ["doc_id", "uid", "shard", "extra"]
    for i, t in enumerate(texts):
        n, h, names = brute_hits(t, [x for x in named if x[0] is not None])
        _, every, _ = brute_hits(t, named)  # an item without an id hits words but is never named
        assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"]) == (n, every if every != h else h, names), t
    clash = decontaminate.hits(docs_frame(spark, texts).selectExpr("*", "'x' as items", "1 as spans"), bench)
    assert clash.columns == ["doc_id", "uid", "shard", "n_words", "n_hit", "spans", "items"]
    empty = decontaminate.hits(docs_frame(spark, texts[:3]), bench.limit(0), "text").collect()
    assert [(r.n_hit, r["items"]) for r in empty] == [(0, [])] * 3
    assert decontaminate.hits(docs_frame(spark, []), bench).count() == 0


def test_without_contaminated_keeps_columns_and_rows(spark):
    item = " ".join(f"q{i}" for i in range(20))
    texts = [item, "clean text", "clean text", None, " ".join(f"z{i}" for i in range(1000)) + " " + item]
    out = decontaminate.without_contaminated(docs_frame(spark, texts, [0, 1, 1, None, 4]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == ["1", "1", "4", "None"]
    assert out.columns == ["doc_id", "text", "uid", "shard", "n_words"]


def test_winnowing_guarantee():
    rnd = random.Random(1)
    import numpy as np

    for _ in range(50):
        shared = np.array([rnd.getrandbits(64) for _ in range(13)], np.uint64)
        prints = []
        for _ in range(2):
            a, b = (np.array([rnd.getrandbits(64) for _ in range(rnd.randrange(0, 30))], np.uint64) for _ in range(2))
            w = np.concatenate([a, shared, b])
            at, h = decontaminate.winnow(w, np.array([0, len(w)]), 5, 9)
            prints.append({int(x) for p, x in zip(at, h) if len(a) <= p <= len(a) + 8})
        assert prints[0] & prints[1]


# ---- exact duplicates --------------------------------------------------------------------------


def test_minimal_perfect_hash():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    sizes, bits = exact_dedup.build_hash(b"".join(digests))
    slots = exact_dedup.slots(b"".join(digests), sizes, bits)
    assert sorted(slots.tolist()) == list(range(5000))
    assert exact_dedup.build_hash(b"")[0] == []
    other = hashlib.sha256(b"other").digest()
    assert -1 <= exact_dedup.slots(other, sizes, bits)[0] < 5000


def test_exact_dedup(spark):
    texts = ["a  b", "a\tb", " a b", None, "", "a b", "x" * 200000, "x" * 200000, "\n", " ", "A b"] + ["hot"] * 50
    ids = [5, 3, 9, 2, 8, 3, 7, 1, 20, 21, 22] + list(range(100, 150))
    got = exact_dedup.dedup(docs_frame(spark, texts, ids).repartition(3)).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    size, least = collections.Counter(norm), {}
    for i, t in zip(ids, norm):
        least[t] = min(i, least.get(t, i))
    assert sorted((r.id, r.keep_id, r.group_size, bytes(r.digest)) for r in got) == sorted(
        (i, least[t], size[t], hashlib.sha256(t.encode()).digest()) for i, t in zip(ids, norm))
    assert sum(r.uid == r.keep_uid for r in got) == len(size)
    kept = exact_dedup.keep_first(docs_frame(spark, texts, ids)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values())
    nulls = exact_dedup.dedup(docs_frame(spark, ["q", "q", "r"], [None, 4, None])).collect()
    assert sorted((str(r.id), str(r.keep_id)) for r in nulls) == [("4", "4"), ("None", "4"), ("None", "None")]
    assert exact_dedup.dedup(docs_frame(spark, [])).count() == 0 and exact_dedup.keep_first(docs_frame(spark, [])).count() == 0


def test_history_lookup_checks_whole_digests(spark):
    rows = [(hashlib.sha256(str(i).encode()).digest(), i, i) for i in range(300)]
    index = exact_dedup.build_index(spark.createDataFrame(rows, "digest binary, id long, uid long"), 4)
    asked = [(hashlib.sha256(str(i).encode()).digest(), 1, 1000 + i, 1000 + i) for i in range(200, 400)]
    got = exact_dedup.look_up(spark.createDataFrame(asked, "digest binary, n long, id long, uid long"), index, 4).collect()
    assert {bytes(r.digest): (r.member, r.id) for r in got} == {d: (i < 1300, i - 1000 if i < 1300 else i) for d, _, i, _ in asked}


def test_winners_of_known_digests_come_from_the_index(spark, monkeypatch):
    texts, ids = ["a", "a", "b", "c", "c", "b", "d"], [1, 2, 3, 4, 11, 12, 13]
    build = exact_dedup.build_index
    monkeypatch.setattr(exact_dedup, "build_index", lambda history, shards: build(history.withColumn("id", F.col("id") + 1000), shards))
    got = {r.id: (r.keep_id, r.group_size, r.member) for r in exact_dedup.dedup(docs_frame(spark, texts, ids)).collect()}
    assert got == {1: (1001, 2, True), 2: (1001, 2, True), 3: (1003, 2, True), 12: (1003, 2, True), 4: (1004, 2, True), 11: (1004, 2, True), 13: (13, 1, False)}


# ---- sharding ----------------------------------------------------------------------------------


def test_shards(spark):
    rnd = random.Random(3)
    texts = ["t" * rnd.randrange(0, 300) + str(i) for i in range(600)] + ["copy of one text"] * 300 + [None, "", "é" * 40]
    got = sharding.shard(docs_frame(spark, texts).repartition(5)).collect()
    by_id = {r.id: r for r in got}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (by_id[i].size, by_id[i].text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    assert all(sorted(x.slot for x in rows) == list(range(len(rows))) for rows in shards.values())
    total = sum(r.size for r in got)
    assert set(shards) == set(range(16)) and max(abs(sum(x.size for x in rows) - total / 16) for rows in shards.values()) < 700
    assert sharding.shard(docs_frame(spark, [])).count() == 0
    few = sharding.shard(docs_frame(spark, ["a", "a"], [1, None])).collect()
    assert len(few) == 2 and all(0 <= r.shard < 16 for r in few)


def test_hot_key_is_subdivided_and_small_groups_stay(spark):
    texts = ["hot text"] * 4000 + [f"pair {i // 2}" for i in range(4000)]
    got = sharding.shard(docs_frame(spark, texts), 8).join(docs_frame(spark, texts).select(F.col("doc_id").alias("id"), "text"), "id")
    per = {r.text: r.s for r in got.groupBy("text").agg(F.count_distinct("shard").alias("s")).collect()}
    assert per.pop("hot text") >= 4 and set(per.values()) == {1}
    records = got.select(F.xxhash64("text").alias("key"), "uid", "size")
    _, sizes = sharding.splitters(records, 32)
    assert max(b for _, b, _ in sizes) <= 2 * sum(b for _, b, _ in sizes) / 32


def test_written_shards(spark):
    texts = [f"text {i}" for i in range(100)] + [None]
    path = sharding.write_shards(docs_frame(spark, texts), 4)
    back = spark.read.parquet(path)
    assert back.count() == 101 and {r._shard for r in back.select("_shard").distinct().collect()} == {0, 1, 2, 3}


# ---- licences ----------------------------------------------------------------------------------


def test_known_sentences():
    known, every = license_rules.known(), {i for _, ids in license_rules.RULES for i in ids}
    assert every == set(license_rules.SENTENCES) and len(set(known)) == len(known)
    by_id = collections.defaultdict(list)
    for s, i in known.items():
        by_id[i].append(s)
    for _, ids in license_rules.RULES + [(n, [f"ref {n}"]) for n in license_rules.NAMES]:
        assert all(any(re.search(license_rules.KEYWORDS, s) for s in by_id[i]) for i in ids[:1]) or any(
            re.search(license_rules.KEYWORDS, s) for i in ids for s in by_id[i])


def licences(spark, texts):
    return {r.doc_id: r for r in license_rules.scan(docs_frame(spark, texts)).collect()}


def test_licence_rules(spark):
    s = license_rules.SENTENCES
    mit = "\n\n".join([s["mit-grant"].replace(" documentation ", " documentation\n"), s["mit-notice"], "# " + s["mit-as-is"].replace("KIND,", "KIND,\n#")]) + " " + s["mit-liability"]
    texts = [mit, "Intro.\nLicensed under the Apache License, Version 2.0.\nMore", s["mit-grant"] + "\n" + s["bsd-source"] + "\n" + s["mit-notice"],
             None, "", "no licence here", "Released under the MIT License\nmore words", s["mit-notice"] + " " + s["mit-grant"],
             "x. " * 20000 + "All rights reserved."]
    got = licences(spark, texts)
    told = lambda i: [(m.licence, m.start, m.stop) for m in got[i].licences]
    assert [x[0] for x in told(0)] == ["MIT"] and got[0].sentence_ids == ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]
    assert told(1) == [("Apache-2.0", 2, 2)]
    assert told(2) == [] and got[2].sentence_ids == ["mit-grant", "bsd-source", "mit-notice"]  # a known sentence stands between
    assert [told(i) for i in (3, 4, 5)] == [[], [], []]
    assert told(6) == [("MIT", 1, 1)] and told(7) == [] and told(8) == [("All-rights-reserved", 20001, 20001)]
    clash = docs_frame(spark, texts[6:7]).selectExpr("*", "'x' as licences")
    assert [m.licence for m in license_rules.scan(clash).first().licences] == ["MIT"]
    assert license_rules.scan(docs_frame(spark, [])).count() == 0


NOTICES = {  # as published, with their line breaks
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "Apache-2.0": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    "GPL-2.0-or-later": """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.
""",
    "GPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
""",
    "MPL-2.0": """  This Source Code Form is subject to the terms of the Mozilla Public
  License, v. 2.0. If a copy of the MPL was not distributed with this
  file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-2.0": """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; version 2.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "Copyright (c) 2020 A. All rights reserved.",
}
NOTICES["BSD-3-Clause"] = NOTICES["BSD-2-Clause"] + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
NO_WARRANTY = """
    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""


def test_published_notices(spark):
    assert set(NOTICES) == {licence for licence, _ in license_rules.RULES}
    gpl = NOTICES["GPL-3.0-or-later"]
    every = list(NOTICES.items()) + [(n, NOTICES[n] + NO_WARRANTY) for n in ("GPL-2.0-or-later", "GPL-3.0-or-later")]
    every += [("GPL-3.0-or-later", x) for x in (
        gpl.replace("This program", "Some Tool"), gpl.replace("software: you", "software:\n    you"), gpl.replace("free software", "free\n# software"),
        " ".join(gpl.split()), "Note: free software: " + gpl)]
    got = licences(spark, [x for _, x in every])
    assert [[m.licence for m in got[k].licences] for k in range(len(every))] == [[n] for n, _ in every]
    first = {licence: ids for licence, ids in reversed(license_rules.RULES)}
    assert all(got[k].sentence_ids == first[n] for k, (n, _) in enumerate(every) if n not in ("GPL-2.0-or-later", "GPL-3.0-or-later"))
    assert [got[k].sentence_ids for k in (len(NOTICES), len(NOTICES) + 1)] == [first["GPL-2.0-or-later"], first["GPL-3.0-or-later"]]


def test_filter_passes_every_known_sentence(spark):
    known = list(license_rules.known())
    for between in (" ", "\n", " ** ", "\n# "):
        assert all(re.search(license_rules.keywords(), between.join(s.split())) for s in known)
    texts = {"Released under\nMIT.": "ref MIT", "Distributed under **MIT**": "ref MIT", "Released under `ISC`": "ref ISC", "Released under\nthe GPLv2.": "ref GPL-2.0",
             "This is free and unencumbered software released into the public\ndomain.": "unlicense-head", "All rights\nreserved.": "reserved",
             license_rules.SENTENCES["mpl-copy"]: "mpl-copy"}
    got = licences(spark, list(texts))
    assert [got[k].sentence_ids for k in range(len(texts))] == [[i] for i in texts.values()]


def test_sentences_on_any_number_of_lines(spark):
    texts = ["\n".join(textwrap.wrap(license_rules.SENTENCES["mit-grant"] + "\n" + license_rules.SENTENCES["mit-notice"], width, break_long_words=False)).replace(
        "conditions: ", "conditions:\n") for width in (1, 10, 20, 36, 60)]
    known = license_rules.known()
    got = licences(spark, texts + ["\n".join(s.split()) for s in known])
    assert [[m.licence for m in got[k].licences] for k in range(len(texts))] == [["MIT"]] * len(texts)
    assert all(i in got[k].sentence_ids for k, i in enumerate(known.values(), len(texts)))


# ---- WARC --------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, sha string, target string, key int"


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, None, "x", 1) for r in rows], PAGES)


def test_archives_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c d\r\nX: y", ""), (5, "http://e", "\r\n\r\nWARC/1.1\r\n\r\n"),
            (6, "http://f", "é" * 500000), (7, "http://g", "same"), (None, "http://n", "same"), (8, "http://h", "alone"), (8, "http://h", "alone")]
    manifest = warc.archive(pages_frame(spark, rows))
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(manifest).collect())
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(i or -1, top.get(h or "", -1))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = (i or -1) != top[h or ""]
        want.append((str(i), len(raw), warc.payload_digest(raw), "revisit" if again else "response", top[h or ""] if again else None))
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)
    assert warc.read_records(warc.archive(pages_frame(spark, []))).count() == 0
    urls = {r.page_id: r.url for r in warc.read_records(manifest).collect()}
    assert urls[4] == "http://c%20d%0D%0AX:%20y" and urls[3] is None


def test_normaliser_members_and_index():
    records = [warc.record(i, f"http://x/{i}", b"p" * i * 70000, "D", None, False) for i in range(5)]
    whole = gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:]))  # members may hold several records
    out = io.BytesIO()
    entries = list(warc.normalise(io.BytesIO(whole), out))
    raw = out.getvalue()
    assert [zlib.decompress(raw[e["offset"]:e["offset"] + e["length"]], 31) for e in entries] == records
    assert gzip.decompress(raw) == b"".join(records) and sum(e["length"] for e in entries) == len(raw)
    with pytest.raises(EOFError):
        list(warc.normalise(io.BytesIO(whole[:-200]), io.BytesIO()))
