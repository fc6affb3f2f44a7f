"""Token files, BPE, near duplicates, toxicity, language-model scores and the pipeline."""

import collections
import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from contentflow.llm import bag_minhash, bpe, components, lm_score, pretokens, token_codes, toxicity
from contentflow.llm.common import text_bytes
from test_text_operators import docs_frame, words

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  two  spaces ", "it's we'll 'so '", "<|endoftext|>", "line\n\n  next\t1234 ²", "日本語 テキスト", "😀 👩‍👩‍👧", "a" * 3000, "x y " * 30000,
       "don't can't I'VE", " nb sp", "tab\t\tend\t"]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_pretokens_equal_the_pattern():
    import regex

    pattern, rnd = regex.compile(P.PATTERN), random.Random(2)
    signs = ["'", "s", "t", "re", "ll", "d", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "日", " ", "😀", "S", "\x1c", "​"]
    for _ in range(600):
        texts = ["".join(rnd.choices(signs, k=rnd.randrange(12))) for _ in range(6)]
        data, off = text_bytes(pa.array(texts))
        cuts, before = pretokens.pretokens(data, off)
        raw = data.tobytes()
        got = [raw[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:])]
        assert [got[a:b] for a, b in zip(before[:-1], before[1:])] == [pattern.findall(t) for t in texts]


# ---- token files -------------------------------------------------------------------------------


def test_codes_random_access():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 2 ** 32, 500), [0, 255, 256, 65535, 65536, 2 ** 32 - 1]]).astype(np.uint32)
    rng.shuffle(ids)
    code = token_codes.CodeFile(pa.BufferReader(token_codes.file_bytes([7, None], [1000, len(ids) - 1000], ids)))
    assert (code.tokens() == ids).all() and [code.token(i) for i in range(len(ids))] == ids.tolist()
    assert code.documents()[0] == [7, None]
    with pytest.raises(IndexError):
        code.token(len(ids))
    assert len(token_codes.CodeFile(pa.BufferReader(token_codes.file_bytes([], [], np.zeros(0, np.uint32)))).tokens()) == 0


def test_token_files(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    ids = [30, 2, 17, 5, 8, 4, 99, 1, 0, 6, 3, 11, 12, 13]
    got = token_codes.read_codes(token_codes.write_codes(docs_frame(spark, ODD, ids), P.path("byte_bpe_50k.json"))).orderBy("doc_id").collect()
    start = 0
    for r, (i, t) in zip(got, sorted(zip(ids, ODD))):
        tokens = model.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(tokens), zlib.crc32(np.array(tokens, "<u4")))
        start += len(tokens)
    again = token_codes.read_codes(token_codes.write_codes(docs_frame(spark, ["b", "a", "a"], [None, 1, 1]), P.path("byte_bpe_50k.json"))).collect()
    assert sorted((r.start, str(r.doc_id)) for r in again) == [(0, "1"), (2, "1"), (4, "None")]
    assert token_codes.read_codes(token_codes.write_codes(docs_frame(spark, []), P.path("byte_bpe_50k.json"))).count() == 0


# ---- BPE ---------------------------------------------------------------------------------------


def test_bpe(spark, tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 5000)
    path = P.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs_frame(spark, ODD).repartition(3), path, P.PATTERN)
    for r in bpe.decode(encoded, path).collect():
        assert bytes(r.decoded) == (ODD[r.id] or "").encode()
    assert {r.id: list(r.ids) for r in encoded.collect()} == {i: tiktoken_encoding.encode_ordinary(t or "") for i, t in enumerate(ODD)}
    for r in bpe.digests(encoded, path).collect():
        ids = tiktoken_encoding.encode_ordinary(ODD[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.encode(docs_frame(spark, []), path, P.PATTERN).count() == 0
    twice = bpe.encode(docs_frame(spark, ["a b", "a b", None], [None, 1, 1]), path, P.PATTERN).collect()
    assert sorted(len(r.ids) for r in twice) == [0, 2, 2]


# ---- near duplicates ---------------------------------------------------------------------------


def bag(text):
    w = words(text)
    return collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute_classes(texts):
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = bags[i], bags[j]
        if a and b and 5 * sum((a & b).values()) >= 4 * sum((a | b).values()):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_signature_is_unbiased():
    rng, m = np.random.default_rng(1), 4096
    for _ in range(3):
        a = collections.Counter(rng.integers(0, 200, 700).tolist())
        b = a.copy()
        for k in rng.choice(200, 70):
            b[int(k)] = int(rng.integers(1, 40))
        rows = [(0, k, v) for k, v in a.items()] + [(1, k, v) for k, v in b.items()]
        s = bag_minhash.signatures(np.array([r[0] for r in rows]), bag_minhash.mix(np.array([r[1] for r in rows], np.uint64)), np.array([r[2] for r in rows]), 2, m)
        true = sum((a & b).values()) / sum((a | b).values())
        assert abs((s[0] == s[1]).mean() - true) < 5 * (true * (1 - true) / m) ** 0.5


def near_texts():
    rnd = random.Random(4)
    make = lambda n: [rnd.choice("abcdefghij") + str(rnd.randrange(300)) for _ in range(n)]
    base, passage = make(120), make(60)
    texts = [" ".join(base)] * 3
    chain = list(base)
    for step in range(6):  # each close to the one before, the ends far apart
        chain = chain[:step * 14] + [f"edit{step}"] + chain[step * 14 + 1:]
        texts.append(" ".join(chain))
    for i in range(60):  # a large group of near copies
        w = list(base)
        w[rnd.randrange(120)] = f"n{i}"
        texts.append(" ".join(w))
    texts += [" ".join(make(60) + passage) for _ in range(40)]  # a passage that many texts share
    texts += [None, "", "!!!", "one two", "One, two", "one two three", "spam " * 500, "spam " * 450, "spam " * 90]
    return texts


def test_near_duplicates(spark, monkeypatch):
    texts = near_texts()
    monkeypatch.setattr(bag_minhash, "TILE", 16)
    got = bag_minhash.near_duplicates(docs_frame(spark, texts).repartition(3)).collect()
    assert {r.id: r.class_id for r in got} == dict(enumerate(brute_classes(texts)))
    assert sum(r.keeps for r in got) == len(set(brute_classes(texts)))
    assert all(r.class_size == sum(q.class_id == r.class_id for q in got) for r in got)
    kept = bag_minhash.one_of_each(docs_frame(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute_classes(texts)))
    odd = bag_minhash.one_of_each(docs_frame(spark, ["a b c"] * 3 + [None], [None, 2, 2, None])).collect()
    assert sorted(str(r.doc_id) for r in odd) == ["2", "None"]
    assert bag_minhash.near_duplicates(docs_frame(spark, [])).count() == 0


def test_components(spark):
    rnd = random.Random(9)
    links = [(i, i + 1) for i in range(50)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(30)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root if find(x) != x}
    assert {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()} == want


# ---- toxicity ----------------------------------------------------------------------------------


def toxic_corpus(n=600):
    rnd = random.Random(6)
    vocab = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(3, 9))) for _ in range(400)]
    texts, marks = [], []
    for i in range(n):
        w, bad = rnd.choices(vocab, k=rnd.randrange(5, 120)), i % 5 == 0
        if bad:
            for _ in range(rnd.randrange(1, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(["zorkig", "zorkend", "Plonx", "quuxer"])
        texts.append(" ".join(w))
        marks.append(int(bad))
    return texts, marks


def test_toxicity_held_out(spark):
    texts, marks = toxic_corpus()
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(None, 1, 1), (9999, 0, None)], "doc_id long, quality int, toxic int")
    docs = docs_frame(spark, texts + [None, "", "calm"], [*range(len(texts)), 5000, 5001, None])
    model, every = toxicity.fit(docs, labels)
    score = {r.id: r.score for r in toxicity.score_features(model, every).collect()}
    out = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((score[i] >= 0.3) == bool(marks[i]) for i in out) / len(out) > 0.97
    assert all(0 <= s <= 1 for s in score.values()) and score[5000] == score[5001] < 0.3
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    again, _ = toxicity.fit(docs, flipped)  # held-out labels are never read
    assert (again.weights == model.weights).all()
    kept = toxicity.without_toxic(docs, labels).collect()
    assert {r.doc_id for r in kept} == {i for i, s in score.items() if s < 0.3}


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model, every = toxicity.fit(docs_frame(spark, ["a", None]), labels)
    assert all(r.score < 0.6 for r in toxicity.score_features(model, every).collect())
    model, every = toxicity.fit(docs_frame(spark, []), labels)
    assert every.count() == 0


def test_label_model_finds_accuracy_and_correlation():
    rng, n = np.random.default_rng(3), 20000
    y = rng.random(n) < 0.2
    votes = np.zeros((n, 4), np.int8)
    for v, (hit, false) in enumerate([(0.9, 0.02), (0.6, 0.05), (0.5, 0.1)]):
        votes[:, v] = np.where(rng.random(n) < np.where(y, hit, false), 1, 0)
    votes[:, 3] = votes[:, 2]  # a copy of a voter
    patterns, index = np.unique(votes, axis=0, return_inverse=True)
    counts = np.bincount(index.ravel())
    known = np.stack([np.bincount(index.ravel()[:400], weights=(y[:400] == c), minlength=len(patterns)) for c in (0, 1)], axis=1)
    model = toxicity.fit_label_model(patterns, counts, known)
    assert abs(model.tables[1, 0, 2] - 0.9) < 0.08 and abs(model.tables[0, 0, 2] - 0.02) < 0.03
    assert model.correlations[2, 3] > 0.9 and model.weights[2] < 0.6 < model.weights[0]


# ---- language model ----------------------------------------------------------------------------


def test_masked_scores_equal_plain_loops(spark):
    texts = ["a b c d e f g a b c", None, "", "zz", "a b a b a b a b"]
    net, numbered = lm_score.train(docs_frame(spark, texts).selectExpr("doc_id as id", "text"), rounds=1)
    got = {r.id: r for r in lm_score.score_words(numbered, net).collect()}
    for r in numbered.collect():
        w, total = np.frombuffer(bytes(r.words), np.uint16).astype(int), 0.0
        for i in range(len(w)):
            h = net.bias.astype(float).copy()
            for k, o in enumerate(lm_score.OFFSETS):
                x = w[i + o] if 0 <= i + o < len(w) else lm_score.PAD
                h += net.embed[x].astype(float) * net.place[k]
            h = np.tanh(h)
            c, m = w[i] % lm_score.CLASSES, w[i] // lm_score.CLASSES
            for z, at in ((h @ net.to_class + net.class_bias, c), (h @ net.to_member[c] + net.member_bias[c], m)):
                total += z[at] - np.log(np.exp(z - z.max()).sum()) - z.max()
        assert got[r.id].n_words == len(w) and abs(got[r.id].log_likelihood - total) < 1e-3
    rows = {r.id: r for r in lm_score.score(docs_frame(spark, texts)).collect()}
    assert rows[1].log_likelihood == 0 and rows[2].mean_log_likelihood is None and len(rows) == 5
    assert lm_score.score(docs_frame(spark, [])).count() == 0


def test_training_beats_word_shares(spark):
    rnd = random.Random(8)
    pairs = [(f"k{i}", f"v{i}") for i in range(30)]  # the second word follows from the first
    text = lambda: " ".join(x for _ in range(60) for x in rnd.choice(pairs))
    docs = docs_frame(spark, [text() for _ in range(300)]).selectExpr("doc_id as id", "text")
    mean = []
    for rounds in (0, 3):
        net, numbered = lm_score.train(docs, rounds)
        r = lm_score.score_words(numbered, net).selectExpr("sum(log_likelihood) / sum(n_words) as m").first()
        mean.append(r.m)
    assert mean[1] > mean[0] + 0.1  # three averaged rounds of one step each
    lists = [np.frombuffer(bytes(r.words), np.uint16) for r in numbered.collect()]
    joined, at, _ = lm_score.windows(lists)
    trainer, held = lm_score.Trainer(net), at[-4000:]
    for k in range(150):
        some = np.random.default_rng(k).choice(at[:-4000], 2000)
        trainer.step(joined[some], lm_score.context_of(joined, some))
    assert lm_score.log_chances(trainer.net, joined[held], lm_score.context_of(joined, held)).mean() > mean[0] + 1


def test_gradient_sums_by_place_and_word_without_sorting(monkeypatch):
    rng = np.random.default_rng(5)
    net = lm_score.new_network(rng.random(lm_score.PAD) * 100)
    net.place[:] = rng.normal(1, 0.3, net.place.shape)
    words, context = rng.integers(0, lm_score.PAD, 300), rng.integers(0, 40, (2 * lm_score.SIDE, 300))
    context[:, :9] = lm_score.PAD
    loss = lambda: -lm_score.log_chances(net, words, context).mean()
    monkeypatch.setattr(np, "unique", None)  # no sort of all words around, which took two fifths of a step
    got = lm_score.gradient(net, words, context)
    monkeypatch.undo()
    for param, found, at in ((net.embed, got.embed, (3, 5)), (net.embed, got.embed, (lm_score.PAD, 0)), (net.place, got.place, (2, 7)), (net.bias, got.bias, (4,))):
        kept, low_high = param[at], []
        for step in (-0.01, 0.01):
            param[at] = kept + step
            low_high.append(loss())
        param[at] = kept
        assert found[at] == pytest.approx((low_high[1] - low_high[0]) / 0.02, rel=0.02, abs=2e-6)
    assert not got.embed[41:lm_score.PAD].any() and got.embed.dtype == got.place.dtype == np.float32



def test_every_position_is_trained_once(spark):
    lists = [np.arange(n, dtype=np.uint16) for n in (0, 1, 2, 7, 0, 8, 13)]
    _, at, text = lm_score.windows(lists)
    seen = np.concatenate([lm_score.targets(at, text, turn) for turn in range(lm_score.ROUNDS)])
    assert sorted(seen) == sorted(at)
    rnd = random.Random(4)
    body = lambda: " ".join(f"a b k{i} v{i}" for i in (rnd.randrange(30) for _ in range(40)))
    docs = docs_frame(spark, [body() for _ in range(300)]).selectExpr("doc_id as id", "text")
    mean = []
    for rounds in ((0,), ()):  # none, and as many as score() has
        net, numbered = lm_score.train(docs, *rounds)
        joined, at, _ = lm_score.windows([np.frombuffer(bytes(r.words), np.uint16) for r in numbered.collect()])
        late = np.concatenate([at[2::4], at[3::4]])  # all texts have a multiple of four words
        mean.append(lm_score.log_chances(net, joined[late], lm_score.context_of(joined, late)).mean())
    assert mean[1] > mean[0] + 0.1


@pytest.mark.parametrize("near_share", [1, 11_000, 10**6])  # all words joined, some, none
def test_rare_words_count_by_their_share_of_the_bucket(spark, monkeypatch, near_share):
    monkeypatch.setattr(lm_score, "NEAR_SHARE", near_share)
    counts = collections.Counter({f"w{i}": 6 for i in range(lm_score.VOCABULARY)} | {f"r{i}": 1 + i % 5 for i in range(2000)})
    every = sorted(counts.elements())
    random.Random(2).shuffle(every)
    texts = [" ".join(every[k: k + 100]) for k in range(0, len(every), 100)] + ["", None]
    docs = docs_frame(spark, texts, [7] * len(texts))  # equal ids
    low, starts, ends, _ = lm_score.word_spans(*lm_score.text_bytes(pa.array([" ".join(counts)])))
    bucket = {w: int(h % lm_score.BUCKETS) for w, h in zip(counts, lm_score.span_hashes(low, starts, ends).tolist()) if w[0] == "r"}
    total = collections.Counter()
    for w, b in bucket.items():
        total[b] += counts[w]
    net, numbered, table = lm_score.fit(docs.selectExpr("doc_id as id", "text"), rounds=0)
    plain = sorted(r.log_likelihood for r in lm_score.score_words(numbered, net).collect())
    share = [sum(np.log(counts[w] / total[bucket[w]]) for w in (t or "").split() if w in bucket) for t in texts]
    got = {r.key: r.within for r in numbered.collect()}
    for r in lm_score.far_logs(numbered, table).collect():
        got[r.key] += r.far_log
    assert np.allclose(sorted(got.values()), sorted(share))
    monkeypatch.setattr(lm_score.fit, "__defaults__", (0,))  # score() trains no round, so the network is the same
    rows = lm_score.score(docs).collect()
    assert len(rows) == len(texts) and abs(sum(r.log_likelihood for r in rows) - sum(plain) - sum(share)) < 1e-3
    assert sum(share) < -1000


# ---- pipeline ----------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_pipeline_stages_against_brute_force(spark, tiktoken_encoding, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert k == len(corpus_pipeline.STAGES) - 1 or frames[-1].columns == columns
    rows = [{r.doc_id: r for r in f.collect()} for f in frames]
    import re

    least = {}
    for i, r in rows[1].items():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        least[key] = min(i, least.get(key, i))
    assert set(rows[2]) == set(least.values())
    order = sorted(rows[2])
    assert set(rows[3]) == {order[c] for c in brute_classes([rows[2][i].text for i in order])}
    from test_text_operators import brute_hits

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = set()
    for i, r in rows[3].items():
        n, h, _ = brute_hits(r.text, items)
        bad |= {i} if h and 20 * h >= n else set()
    assert set(rows[4]) == set(rows[3]) - bad
    assert {i: r.n_tokens for i, r in rows[5].items()} == {i: len(tiktoken_encoding.encode_ordinary(r.text or "")) for i, r in rows[4].items()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == set(rows[5])


def test_pipeline_takes_odd_documents(spark):
    rows = [(1, "a b c d e f", "en", None, 11), (1, "a b c d e f", None, "s", 11), (None, None, None, None, None), (None, None, None, None, None),
            (2, "", "de", "s", 0), (3, "x " * 50000, "en", "s", 100000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'e' as key", "1 as uid", "2 as words")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "3"]  # no text and an empty one are equal
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_rank_file_has_every_byte():
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    assert all(bytes([b]) in ranks for b in range(256)) and sorted(ranks.values()) == list(range(len(ranks)))
