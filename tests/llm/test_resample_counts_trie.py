"""Importance resampling, token counts and the prefix trie against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contentflow.llm import crc_columns, prefix_trie, resample, spans, token_counts
from contentflow.llm.common import text_bytes
from test_text_operators import docs_frame as docs_with_ids
from test_text_operators import words

P = pytest.importorskip("public_tokenizers")


def docs_frame(spark, rows):
    return docs_with_ids(spark, [t for _, t in rows], [i for i, _ in rows])


# ---- columns of CRCs and distinct spans --------------------------------------------------------


def test_crc_by_columns():
    rnd = random.Random(1)
    size = crc_columns.SEGMENT
    texts = [rnd.randbytes(rnd.choice([0, 1, 2, 7, size - 1, size, size + 1, 2 * size, 9 * size + 5])) for _ in range(300)]
    got = crc_columns.crc32(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
    assert got.tolist() == [zlib.crc32(t) for t in texts]
    assert crc_columns.crc32(np.zeros(0, np.uint8), np.zeros(0, np.int64)).tolist() == []


def test_distinct_spans_tell_colliding_hashes_apart(monkeypatch):
    data, off = text_bytes(pa.array(["a b a", "bb a", "", " b"]))
    starts, ends, before = spans.chunk_spans(data, off)
    for broken in (False, True):
        if broken:
            monkeypatch.setattr(spans, "span_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
        of, index = spans.distinct_spans(data, starts, ends)
        found = [bytes(data[starts[i]: ends[i]]) for i in of.tolist()]
        assert [found[i] for i in index.tolist()] == [b"a", b"b", b"a", b"bb", b"a", b"b"] and len(set(found)) == len(found)
    assert before.tolist() == [0, 3, 5, 5, 6]


# ---- resampling ----------------------------------------------------------------------------------


def plain_scores(rows, target, buckets, share, least, seed):
    def feats(text):
        w = words(text)
        return [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]], len(w)

    docs = [(i, *feats(t)) for i, t in rows]
    s = collections.Counter(b for _, f, _ in docs for b in f)
    t = collections.Counter(b for x in target for b in feats(x)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, f, n in docs:
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    k = share * sum(n >= least for *_, n in out) // 100
    drawn = sorted((-sc, i is None, i or 0) for i, _, _, sc, n in out if n >= least)[:k]
    return [x[:4] for x in out], drawn


@pytest.mark.parametrize("buckets", [50, 100_000])
def test_resample_equals_plain_python(spark, buckets):
    rnd = random.Random(5)
    vocab = ["alpha", "Beta", "été", "x", "日本", "z" * 2000, "k9"]
    rows = [(i, " ".join(rnd.choices(vocab, k=rnd.randrange(9)))) for i in range(120)]
    rows += [(None, "alpha x k9 x"), (3, rows[3][1]), (3, rows[3][1]), (500, None), (501, ""), (502, "..!"), (503, " ".join(rnd.choices(vocab, k=30_000)))]
    target = ["alpha alpha x", None, "", "x k9"]
    docs = docs_frame(spark, rows)
    bench = spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string")
    got = resample.score(docs, bench, buckets=buckets, share=40, least_words=3, seed=11).collect()
    expected, drawn = plain_scores(rows, target, buckets, 40, 3, 11)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r["id"], r["n_features"], r["weight"], r["score"]) for r in got], key=key) == sorted(expected, key=key)
    ranked = sorted((r["rank"], -r["score"], r["id"] is None, r["id"] or 0) for r in got if r["rank"] is not None)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1)) and [r[1:] for r in ranked] == drawn
    out = resample.resample(docs, bench, buckets=buckets, share=40, least_words=3, seed=11)
    assert out.columns == [*docs.columns, "rank"]
    told = {r["rank"]: r for r in out.collect()}
    assert {k: (r["doc_id"] is None, r["doc_id"] or 0) for k, r in told.items()} == {r[0]: r[2:] for r in ranked}


def test_feature_slices_meet(monkeypatch):
    monkeypatch.setattr(resample, "SLICE_WORDS", 3)
    texts = ["a b c d e f g", "a", "", "b c d"]
    from contentflow.llm.common import word_spans

    low, starts, ends, before = word_spans(*text_bytes(pa.array(texts)))
    pair = np.ones(len(starts), bool)
    pair[[6, 7, 10]] = False
    got = resample.feature_buckets(low, starts, ends, pair, 10_000)
    w = [x for t in texts for x in t.split()]
    assert got[:, 0].tolist() == [zlib.crc32(x.encode()) % 10_000 for x in w]
    assert [got[i, 1] for i in range(len(w)) if pair[i]] == [zlib.crc32(f"{w[i]} {w[i + 1]}".encode()) % 10_000 for i in range(len(w)) if pair[i]]


def test_resample_of_empty_tables(spark):
    docs, bench = docs_frame(spark, []), spark.createDataFrame([], "item_id string, text string")
    assert resample.score(docs, bench).collect() == []
    some = docs_frame(spark, [(1, "a b"), (2, None)])
    assert sorted((r["id"], r["n_features"], r["weight"], r["rank"]) for r in resample.score(some, bench).collect())[1][:3] == (2, 0, 0)


# ---- token counts --------------------------------------------------------------------------------

ODD = [None, "", " ", "the The THE", "don't can't I'VE 'll", "<|endoftext|>", "a<|startoftext|>b <|endoftext", "tab\t\tend\n\n x", " nb sp ", "İstanbul ΑΣ ß ẞ",
       "é é Å Å", "日本語 テキスト", "😀 👩‍👩‍👧", "1234 ²½ x1y2", "!!?? ... --", "\x00\x1c\x7f\x85", "가 가", "w" * 3000, "long words " * 20000, "ﬁ ﬂ"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_counts_equal_the_library(spark, tokenizer):
    rnd = random.Random(2)
    pool = [t for t in ODD if t and len(t) < 100] + ["a", "'s", "́", " ", "ing"]
    texts = ODD + ["".join(rnd.choices(pool, k=rnd.randrange(8))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "the The THE"), (3, "the The THE")]
    got = token_counts.count(docs_frame(spark, rows), P.path("word_bpe_49k.json")).collect()
    expected = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert token_counts.count(docs_frame(spark, []), P.path("word_bpe_49k.json")).collect() == []


def test_every_code_point(tokenizer):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        raw = file.read()
    steps = token_counts.WordTokens(raw)
    counter = token_counts.Counter(raw, steps.proven())
    texts = [chr(i) + "x" for i in range(0x30000) if not 0xD800 <= i < 0xE000 and not (chr(i).isspace())]
    expected = [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [counter.chunk(t.encode()) for t in texts] == expected


def test_proven_tokens_need_no_merge(tokenizer):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        raw = file.read()
    whole = token_counts.WordTokens(raw).proven()
    vocab = tokenizer.get_vocab()
    assert len(whole) > 30_000 and {"the", "!", "don"} <= whole and not {"don't", "The", "", "th e"} & whole
    for s in random.Random(1).sample(sorted(whole), 500):
        ids = tokenizer.encode(s, add_special_tokens=False).ids
        assert len(ids) == 1 and (not (s.isascii() and s.isalnum()) or vocab[s + "</w>"] == ids[0])
    counter = token_counts.Counter(raw, whole)
    assert sum(counter.chunk(c) for c in b"the cat sat".split()) == 3 and counter.merges == 0
    counter.chunk(b"zzxqv,")
    assert counter.merges == 1


def test_tokenizers_that_look_across_white_space_are_refused():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        with pytest.raises(ValueError):
            token_counts.WordTokens(file.read())


# ---- prefix trie -----------------------------------------------------------------------------------


def plain_trie(convs):
    """``convs``: id to list of (role, text)."""
    nodes = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = collections.defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    out = []
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(nodes[k]) - 1) * n + sum(saved[x] for x in kids[k])
        ends = ",".join(map(str, sorted(c for c in nodes[k] if len(convs[c]) == len(k))))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else -99, len(nodes[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def nodes_of(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-99 if r[c] is None else r[c] for c in names) for r in frame.collect())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "kept out", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, node_key string, depth int").repartition(3)


def turns_of(rows):
    told = collections.defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        if c is not None:
            told[c].append((turn is not None, turn or 0, digest, role, text))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in told.items()}


def random_rows(rnd, n):
    rows = []
    for c in range(n):
        if rnd.random() < 0.25 and c:
            rows += [(c, *r[1:]) for r in rows if r[0] == rnd.randrange(c)]  # copies, whole
        text = rnd.choice(["a b", "c", "d  e\tf", None, ""])
        for turn in range(rnd.randrange(1, 7)):
            rows.append((c, turn if rnd.random() < 0.95 else None, rnd.choice(["user", None]), rnd.choice([text, "a b"])))
    return rows


@pytest.mark.parametrize("limit", [1, 5, 10_000])
def test_trie_equals_plain_python(spark, limit, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FIRST_LEVELS", 1)
    rnd = random.Random(limit)
    rows = random_rows(rnd, 60)
    rows += [(200 + i, t, "user", "same") for i in range(30) for t in range(4)]  # a large group of copies
    rows += [(9000 + i, t, "a", "deep") for i in range(12) for t in range(3 * i + 1)]  # each a prefix of the next
    rows += [(None, 0, "user", "no id"), (7777, None, None, None), (7, 0, "user", "twice"), (7, 0, "user", "twice")]
    convs = turns_of(rows)
    frame = prefix_trie.conversations_of(prefix_trie.turn_rows(conversations(spark, rows)), "conv_id")
    found = prefix_trie.trie(frame, limit)
    assert nodes_of(found) == plain_trie(convs)
    keys = {r["node_key"]: r["parent_key"] for r in found.select("node_key", "parent_key").collect()}
    assert len(keys) == found.count() and all(p is None or p in keys for p in keys.values())


def test_rebuilt_conversations(spark):
    rnd = random.Random(9)
    rows = [r for r in random_rows(rnd, 70) if r[0] not in (20, 40)]  # two groups without their first conversation
    rows += [(-41, 0, "u", "x y"), (45, 0, "u", "only")]
    own = turns_of(rows)
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    frame = prefix_trie.trie(prefix_trie.grafted(prefix_trie.turn_rows(conversations(spark, rows)), 20, 4), 3)
    assert nodes_of(frame) == plain_trie(rebuilt)


def test_ids_of_copies_come_in_order(spark):
    ids = [*range(-5, 12_000, 7), 10 ** 12, -(10 ** 12)]
    frame = spark.createDataFrame([(i,) for i in ids], "conv_id bigint").withColumn("turns", F.expr("array(named_struct('id', unhex(repeat('ab', 16)), 'words', 2))"))
    got = nodes_of(prefix_trie.trie(frame))
    told = hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert got == [(min(ids), 0, -99, len(ids), 1, 1, 2 * (len(ids) - 1), prefix_trie.ENDS_OF_NONE), (min(ids), 1, min(ids), len(ids), 0, 1, 2 * (len(ids) - 1), told)]


def test_trie_of_nothing(spark):
    empty = conversations(spark, [])
    assert prefix_trie.trie(prefix_trie.grafted(prefix_trie.turn_rows(empty), 20, 4)).collect() == []
    turnless = spark.createDataFrame([(4,), (3,)], "conv_id bigint").withColumn("turns", F.expr("cast(array() as array<struct<id:binary,words:int>>)"))
    assert nodes_of(prefix_trie.trie(turnless)) == [(3, 0, -99, 2, 0, 1, 0, hashlib.sha256(b"3,4").hexdigest())]
