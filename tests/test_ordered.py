"""Ordered operators against plain Python walks over small random data."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from contentflow.operators import chain, ordering, queueing, similarity, stateful, storage, tfidf, topics

START = dt.datetime(2024, 1, 1)


def log(spark, seed, n=400, keys=3, mean_gap=120, hot=0.6):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += int(rng.expovariate(1 / mean_gap)) if rng.random() > 0.1 else 0
        key = "hot" if rng.random() < hot else f"k{rng.randrange(keys)}"
        rows.append((i, key, START + dt.timedelta(seconds=t), rng.random() > 0.4))
    return rows, spark.createDataFrame(rows, "id long, key string, ts timestamp, ok boolean").repartition(5)


def walk_spaced(rows, gap, strict):
    last, out = {}, {}
    for i, key, ts, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        far = key not in last or ((ts - last[key]).total_seconds() > gap if strict else (ts - last[key]).total_seconds() >= gap)
        out[i] = far
        if far:
            last[key] = ts
    return out


@pytest.mark.parametrize("strict", [True, False])
def test_accept_spaced(spark, strict):
    rows, df = log(spark, 1 if strict else 2)
    got = {r.id: r.accepted for r in stateful.accept_spaced(df, ["key"], "ts", "id", 600, strict).collect()}
    assert got == walk_spaced(rows, 600, strict)


def test_window_dedup_cases(spark):
    rows = [(1, "a", 0), (2, "a", 10), (3, "a", 3600), (4, "a", 3601), (5, "b", 5)]
    df = spark.createDataFrame([(i, k, START + dt.timedelta(seconds=s)) for i, k, s in rows], "id long, key string, ts timestamp")
    got = {r.id: r.accepted for r in stateful.dedup_in_window(df, "key", "ts", "id").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True}
    gate = {r.id: r.accepted for r in stateful.recheck_gate(df, "key", "ts", "id", 3600).collect()}
    assert gate[3] and not gate[2] and not gate[4]


def test_breaker_and_bucket(spark):
    rows, df = log(spark, 3, mean_gap=40)
    states, want = {}, {}
    buckets, want_b = {}, {}
    for i, key, ts, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        t = int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
        states[key], want[i] = stateful.breaker_step(states.get(key, ("closed", 0, 0)), t, ok, 3, 60 * 10**6)
        buckets[key], want_b[i] = stateful.bucket_step(buckets.get(key, (2.0, t)), t, 0.01, 2.0)
    got = {r.id: (r.state_before, r.allowed, r.state_after) for r in stateful.breaker_log(df, "key", "ts", "id", "ok").collect()}
    assert got == want and any(v[0] == "open" for v in got.values())
    got = {r.id: (round(r.tokens, 6), r.throttled, round(r.wait_seconds, 6)) for r in stateful.token_bucket_log(df, "key", "ts", "id", 0.01, 2.0).collect()}
    assert got == {i: (round(a, 6), b, round(c, 6)) for i, (a, b, c) in want_b.items()}


def test_numbering_and_frames(spark):
    rows, df = log(spark, 4)
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    got = {r.id: r.n for r in ordering.numbered(df, ["ts", "id"], ranges=7).collect()}
    assert got == {r[0]: n for n, r in enumerate(order, 1)}
    per = {r.id: r.n for r in ordering.numbered(df, ["ts", "id"], by=["key"], ranges=7).collect()}
    seen = {}
    for r in order:
        seen[r[1]] = seen.get(r[1], 0) + 1
        assert per[r[0]] == seen[r[1]]
    framed = ordering.with_frame(ordering.numbered(df, ["ts", "id"]), "n", 10, F.sum("id"), "s", chunk=50)
    ids = [r[0] for r in order]
    assert {r.n: r.s for r in framed.collect()} == {n + 1: sum(ids[max(0, n - 9):n + 1]) for n in range(len(ids))}
    prev = {r.id: r.prev_ts for r in ordering.with_previous(df, ["key"], "ts", "id", ranges=7).collect()}
    last = {}
    for r in order:
        assert prev[r[0]] == last.get(r[1])
        last[r[1]] = r[2]
    p = {r.key: r.p for r in ordering.nearest_rank(df, ["key"], "id", 0.95, "p").collect()}
    for k in p:
        v = sorted(r[0] for r in rows if r[1] == k)
        assert p[k] == v[int(len(v) * 0.95)]
    same = spark.createDataFrame([(7, i) for i in range(300)] + [(i % 9, 1000 + i) for i in range(60)], "a int, b long").repartition(6)
    parts = ordering.in_ranges(same, ["a", "b"], 8).filter("a = 7").groupBy("_range").count().collect()
    assert len(parts) >= 3  # the hot value is cut by the second column
    got = [(r.a, r.b) for r in ordering.numbered(same, ["a", "b"], ranges=8).orderBy("n").collect()]
    assert got == sorted((r.a, r.b) for r in same.collect())
    names = spark.createDataFrame([("b",), ("á",), ("ab",), ("a",), ("abcdefgh2",), ("abcdefgh1",)], "name string")
    assert [r.name for r in ordering.numbered(names, ["name"], ranges=3).orderBy("n").collect()] == sorted(["b", "á", "ab", "a", "abcdefgh2", "abcdefgh1"])


def test_long_strings_spread_and_long_frames(spark):
    urls = spark.range(20000).selectExpr("concat('https://example.com/', lpad(cast(id as string), 8, '0')) as url").repartition(5)
    sizes = [r["count"] for r in ordering.in_ranges(urls, ["url"], 16).groupBy("_range").count().collect()]
    assert max(sizes) < 4000
    n = spark.range(20).selectExpr("id + 1 as n", "id")
    got = {r.n: r.c for r in ordering.with_frame(n, "n", 6, F.count("id"), "c", chunk=2).collect()}
    assert got == {k: min(k, 6) for k in range(1, 21)}


def test_path_marking_ends_on_loops(spark):
    links = spark.createDataFrame([(0, "a", "b"), (0, "b", "c"), (0, "c", "a"), (0, "x", "y")], "k int, node string, nxt string")
    start = spark.createDataFrame([(0, "a")], "k int, node string")
    assert {r.node for r in stateful.mark_path(start, links, ["k"], "node").collect()} == {"a", "b", "c"}


def test_queue_rules(spark):
    q = spark.createDataFrame([(1, 0, 1), (2, 0, 2), (3, 2, 3)], "id long, rank int, published long")
    assert [r.id for r in queueing.take_next(q, 3).collect()] == [3, 1, 2]
    assert {r.id: r.kept for r in queueing.keep_within_capacity(q, 2).collect()} == {1: True, 2: False, 3: True}
    a = spark.createDataFrame([("i", False, i) for i in range(3)] + [("j", False, 0), ("j", True, 1), ("ok", True, 2)], "item_id string, ok boolean, s int")
    a = a.withColumn("ts", F.timestamp_seconds("s"))
    st = {r.item_id: (r.status, r.retry_count) for r in queueing.retry_state(a, max_retries=2).collect()}
    assert st == {"i": ("failed", 3), "j": ("retrying", 1)}
    sent = spark.createDataFrame([(0, True), (1, True)], "batch_id long, ok boolean")
    assert queueing.sent_until_failure(sent, "ok").count() == 2


def test_store_rules(spark):
    old = spark.createDataFrame([(1, "u1")], "id long, url string")
    new = spark.createDataFrame([(2, "u1"), (3, "u2"), (4, "u2"), (5, None), (6, None)], "id long, url string")
    assert {r.id for r in storage.insert_if_new(new, old, "url", ["id"]).collect()} == {3, 5, 6}
    up = storage.upsert(old.withColumn("v", F.lit("old")), old.withColumn("v", F.lit("new")), ["id"], ["url"])
    assert up.first().v == "new"


TEXTS = ["apple banana cherry", "apple banana cherry", "apple banana date", "stone river mountain", "stone river valley", "apple", "", "river",
         "the apple and the banana", "cherry cherry cherry banana"]


def plain_similarity(a, b):
    import math
    from collections import Counter
    ca, cb = (Counter(w for w in t.split() if len(w) > 1) for t in (a, b))
    idf = {w: math.log(3 / (1 + (w in ca) + (w in cb))) + 1 for w in {*ca, *cb}}
    na, nb = (math.sqrt(sum((c[w] * idf[w]) ** 2 for w in c)) for c in (ca, cb))
    return sum(ca[w] * cb[w] * idf[w] ** 2 for w in ca) / (na * nb) if na and nb else 0.0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_similar_pairs_are_exact(spark, threshold):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(12)]
    texts = TEXTS + [" ".join(rng.choices(vocab, weights=range(1, 13), k=rng.randrange(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "g int, d long, text string")
    found = similarity.similar_pairs(df, ["g"], "d", threshold=threshold)
    got = {(r.a, r.b): round(r.similarity, 6) for r in similarity.expand_pairs(found, ["g"]).collect()}
    want = {(i, j): round(min(plain_similarity(texts[i], texts[j]), 1.0), 6) for i in range(len(texts)) for j in range(i + 1, len(texts))}
    assert got == {p: s for p, s in want.items() if s > threshold + 1e-9}


def test_tiles_of_hot_terms_lose_no_pair(spark):
    texts = ["same rare words here " + f"x{i % 5}" for i in range(60)]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "g int, d long, text string")
    counts = similarity.term_counts(df, ["g"], "d", "text", ())
    pairs = [{(r.a, r.b) for r in similarity.candidate_pairs(counts, ["g"], "d", 0.5, tile).collect()} for tile in (7, 1000)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 60 * 59 // 2


def test_a_common_rare_term_makes_few_candidates(spark):
    """Texts that share one rare word and little else are no candidates; near copies among them are."""
    texts = [f"shared {' '.join(f'own{i}x{j}' for j in range(8))}" for i in range(400)]
    texts += [f"shared {' '.join(f'copy{i // 2}x{j}' for j in range(8))} tail{i}" for i in range(40)]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "g int, d long, text string")
    counts = similarity.term_counts(df, ["g"], "d", "text", ())
    found = similarity.candidate_pairs(counts, ["g"], "d", 0.5).count()
    results = similarity.similar_pairs(df, ["g"], "d").filter("kind = 'pair'").count()
    assert results == 20 and found <= 10 * results


@pytest.mark.parametrize("cap,block", [(None, 3), (4, 7), (None, 64)])
def test_leader_clusters_follow_id_order(spark, cap, block, monkeypatch):
    import numpy as np
    monkeypatch.setattr(topics, "BLOCK", block)
    monkeypatch.setattr(topics, "GROWTH", 4)
    rng = np.random.default_rng(5)
    vecs = rng.random((60, 6)) ** 3
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)] + [(60, None)], "d long, vec array<double>").repartition(4)
    room = cap or max(2, 61 // 2)
    leaders, want = [], {}
    for i, v in enumerate(vecs):
        sims = [float(v @ vecs[j]) for j in leaders]
        if (not sims or max(sims) < 0.9) and len(leaders) < room:
            leaders.append(i)
            want[i] = i
        else:
            want[i] = leaders[int(np.argmax(sims))]
    want[60] = 0
    got = {r.d: r.leader for r in topics.leader_clusters(df, "d", 0.9, cap).collect()}
    assert got == want


def test_themes_and_topics(spark):
    docs = [(1, 1, "The M3 chip brings better performance to laptops"), (1, 2, "Performance of the M3 chip is higher"), (1, 3, "New M3 laptops show performance gains")]
    df = spark.createDataFrame(docs, "g int, d long, text string")
    th = {r.term for r in tfidf.themes(df, ["g"], "d").collect()}
    assert {"m3", "performance"} <= th
    words = spark.createDataFrame([("a", "machine learning"), ("a", "vision"), ("b", "learning"), ("c", "stone")], "label string, term string")
    rel = {(r.a, r.b): round(r.similarity, 6) for r in topics.related_topics(words).collect()}
    assert rel == {("a", "b"): round((0 + 1 / 3) / 2, 6), ("b", "a"): round((0 + 1 / 3) / 2, 6)}


def test_chain_pieces_meet_in_any_order(spark):
    rng = random.Random(4)
    pages = [(c, f"{c}-{i}" if i else "", f"{c}-{i + 1}" if i < 29 else None, 1) for c in "abc" for i in range(30)]
    pages += [("d", "x", "y", 1), ("d", "y", "x", 1), ("d", "", "z", 0)]  # a circle, and a chain that ends at an empty page
    missing = {("b", "b-7"), ("b", "b-20"), ("c", "")}
    pages = [p for p in pages if p[:2] not in missing]
    rng.shuffle(pages)
    schema, pieces = "c string, page_token string, continuation string, n_items int", None
    for k in range(3):
        batch = pages[k * len(pages) // 3:(k + 1) * len(pages) // 3]
        pieces = chain.landed(pieces, spark.createDataFrame(batch, schema), ["c"])
    got = {r["c"]: tuple(r)[1:] for r in chain.chain_status(pieces, ["c"]).collect()}
    assert got == {"a": (30, None, True, 0, 0), "b": (7, "b-7", False, 2, 21), "c": (0, "", False, 1, 29), "d": (1, None, True, 0, 0)}
    late = spark.createDataFrame([("b", "b-7", "b-8", 1), ("c", "", "c-1", 1)], schema)
    done = {r["c"]: tuple(r)[1:] for r in chain.chain_status(chain.landed(pieces, late, ["c"]), ["c"]).collect()}
    assert done["b"] == (20, "b-20", False, 1, 9) and done["c"] == (30, None, True, 0, 0)


@pytest.mark.parametrize("tile_words", [10_000, 900, 600, 150])
def test_every_two_tiles_meet_once(spark, tile_words):
    """Long texts with many words in common, in one tile or in an even or odd number of them: each pair is found once."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    texts = {(g, i): " ".join(rng.choices(vocab, weights=range(1, 41), k=30)) for g in ("x", "y") for i in range(50 if g == "x" else 4)}
    df = spark.createDataFrame([(*k, t.split()) for k, t in texts.items()], "g string, d long, _t array<string>")
    found = [((r.g, r.a, r.b), round(r.similarity, 6)) for r in similarity.pairs_above(df, ["g"], "d", 0.7, tile_words).collect()]
    want = {(g, i, j): round(plain_similarity(a, b), 6) for (g, i), a in texts.items() for (h, j), b in texts.items() if g == h and i < j}
    assert len(found) == len(dict(found)) and dict(found) == {k: s for k, s in want.items() if s > 0.7}


def test_every_two_blocks_meet_once(monkeypatch):
    """The blocks of a tile, with frequent words in matrices and rare ones in pairs of occurrences, a few at a time."""
    import pyarrow as pa

    monkeypatch.setattr(similarity, "BLOCK", 7)
    monkeypatch.setattr(similarity, "HELD", 5)
    monkeypatch.setattr(similarity, "OFTEN", 2)
    rng = random.Random(5)
    texts = [rng.choices([f"w{i}" for i in range(60)], weights=range(1, 61), k=rng.randrange(1, 30)) for _ in range(30)]
    n = len(texts)
    tile = pa.RecordBatch.from_pydict({"g": ["x"] * n, "_id": list(range(n)), "_t": texts, "_tile": [0] * n, "_tiles": pa.nulls(n, pa.int32()), "_big": pa.nulls(n, pa.int32())})
    rows = [r for b in similarity._compare_tiles(["g"], None, 0.3)([tile.slice(0, 11), tile.slice(11)]) for r in b.to_pylist()]
    found = {(r["a"], r["b"]): round(r["similarity"], 6) for r in rows}
    want = {(i, j): round(min(plain_similarity(" ".join(texts[i]), " ".join(texts[j])), 1.0), 6) for i in range(n) for j in range(i + 1, n)}
    assert len(rows) == len(found) and found == {k: s for k, s in want.items() if s > 0.3}


def in_tiles(texts, tiles, folder):
    """The texts as written tiles, and the rows of work for them."""
    import pyarrow as pa
    from pyarrow import parquet as pq

    order = sorted(range(len(texts)), key=lambda i: i % tiles)
    rows = {"_big": [3] * len(texts), "_tile": [i % tiles for i in order], "_id": order, "_t": [texts[i] for i in order]}
    for k, batch in enumerate(similarity._encode_tiles([pa.RecordBatch.from_pydict(rows)])):
        at = folder / f"_big=3/_tile={batch.column('_tile')[0].as_py()}"
        at.mkdir(parents=True, exist_ok=True)
        half = batch.num_rows // 2  # row groups and files may come in any order
        for name, part in (("b", batch.slice(0, half)), ("a", batch.slice(half))):
            pq.write_table(pa.Table.from_batches([part.select(["_at", "_id", "_code", "_tf", "_names"])]), at / f"{name}{k}.parquet")
    steps = range(0, tiles // 2 + 1, similarity.STEPS)
    work = [{"g": "x", "_big": 3, "_tiles": tiles, "_own": own, "_step": step} for own in range(tiles) for step in steps]
    return pa.RecordBatch.from_pylist(work)


@pytest.mark.parametrize("few", [0, 3, 10 ** 6])
@pytest.mark.parametrize("tiles,threshold", [(4, 0.3), (5, 0.3), (8, 0.0), (5, 0.9)])
def test_written_tiles_are_compared_as_numbers(tmp_path, monkeypatch, few, tiles, threshold):
    """Words are looked at when a tile is written, not again for each tile it meets. Pairs that the estimate leaves are summed one by
    one or with their block; sums beyond single precision are exact."""
    for name, value in {"BLOCK": 7, "HELD": 20, "OFTEN": 4, "CELLS": 28, "EXACT": 3, "BUCKETS": 5, "ESTIMATED": 1, "FEW": few, "STEPS": 2}.items():
        monkeypatch.setattr(similarity, name, value)
    rng = random.Random(tiles)
    vocab = [f"w{i}" for i in range(60)]
    texts = [rng.choices(vocab, weights=range(1, 61), k=rng.randrange(1, 40)) for _ in range(40)]
    texts += [[*texts[i], "hot", *["hot"] * rng.randrange(4500, 5500)] for i in range(4)]
    work = in_tiles(texts, tiles, tmp_path)
    monkeypatch.setattr(similarity, "_encoded", None)
    rows = [r for b in similarity._compare_tiles(["g"], str(tmp_path), threshold)([work]) for r in b.to_pylist()]
    found = {(r["a"], r["b"]): r["similarity"] for r in rows}
    want = {(i, j): min(plain_similarity(" ".join(texts[i]), " ".join(texts[j])), 1.0) for i in range(len(texts)) for j in range(i + 1, len(texts))}
    assert len(rows) == len(found) and found == pytest.approx({k: s for k, s in want.items() if s > threshold}, rel=1e-9)


def test_a_tile_without_texts_has_no_pairs(tmp_path):
    import pyarrow as pa

    in_tiles([["same", "words"], ["same", "words", "here"]], 2, tmp_path)
    work = pa.RecordBatch.from_pylist([{"g": "x", "_big": 3, "_tiles": 3, "_own": own, "_step": 0} for own in range(3)])
    rows = [r for b in similarity._compare_tiles(["g"], str(tmp_path), 0.3)([work]) for r in b.to_pylist()]
    assert [(r["a"], r["b"]) for r in rows] == [(0, 1)]


def test_unlike_texts_are_ruled_out_by_the_estimate(monkeypatch):
    """Few pairs are alike: no block is compared as a whole, and few pairs are summed."""
    import pyarrow as pa

    summed, sums = [], similarity._sums
    monkeypatch.setattr(similarity, "_products", None)
    monkeypatch.setattr(similarity, "_sums", lambda a, b, i, j, terms: summed.append(len(i)) or sums(a, b, i, j, terms))
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(4000)]
    texts = [rng.choices(vocab, weights=[1 / (i + 3) for i in range(4000)], k=60) for _ in range(400)]
    texts += [[*t[:50], "end"] for t in texts[:10]]
    batch = pa.RecordBatch.from_pydict({"g": ["x"] * 410, "_id": list(range(410)), "_t": texts})
    found = {(r["a"], r["b"]): r["similarity"] for b in similarity._compare_tiles(["g"], None, 0.5)([batch]) for r in b.to_pylist()}
    want = {(i, j): plain_similarity(" ".join(texts[i]), " ".join(texts[j])) for i in range(410) for j in range(i + 1, 410)}
    want = {k: s for k, s in want.items() if s > 0.5}
    assert found == pytest.approx(want, rel=1e-9) and len(found) >= 10 and sum(summed) < 410 * 409 / 2 / 20


def test_a_tile_has_a_bounded_number_of_texts(spark, monkeypatch):
    """Many short texts are dealt into tiles too, though their words are few."""
    monkeypatch.setattr(similarity, "TILE_TEXTS", 10)
    texts = [["same", "words", f"w{i % 7}", f"v{i}"] for i in range(45)]
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)] + [("y", 1, ["one"]), ("y", 2, ["one", "two"])], "g string, d long, _t array<string>")
    out = similarity.pairs_above(df, ["g"], "d", 0.5)
    found = {(r.g, r.a, r.b): r.similarity for r in out.collect()}
    want = {("x", i, j): plain_similarity(" ".join(texts[i]), " ".join(texts[j])) for i in range(45) for j in range(i + 1, 45)}
    want["y", 1, 2] = plain_similarity("one", "one two")
    assert found == pytest.approx({k: s for k, s in want.items() if s > 0.5}, rel=1e-9)
    tasks = out.select(F.spark_partition_id().alias("p"), "g", "a").filter("g = 'x'").select("p").distinct().count()
    assert tasks > 3


@pytest.mark.parametrize("most_second", [1 << 16, 2])
@pytest.mark.parametrize("n_words,features", [(6, 8), (40, 8), (40, 100)])
def test_corpus_vocabulary_counts_all_that_can_be_in_it(spark, monkeypatch, n_words, features, most_second):
    """Words in most texts are left out but their pairs are not; ties go by name; texts are cut into words once."""
    from collections import Counter

    monkeypatch.setattr(tfidf, "MOST_SECOND", most_second)
    rng = random.Random(n_words)
    names = [f"w{i:02}" for i in range(n_words)]
    texts = [["zeta", *rng.choices(names, k=rng.randrange(1, 8)), "zeta"] for _ in range(30)] + [[], ["single"]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(99, None)], "d long, text string")
    terms = [t + [f"{a} {b}" for a, b in zip(t, t[1:])] for t in texts] + [[]]
    ctf, seen = Counter(w for t in terms for w in t), Counter(w for t in terms for w in set(t))
    want = sorted((w for w in ctf if seen[w] <= 0.9 * len(terms)), key=lambda w: (-ctf[w], w))[:features]
    words = tfidf.corpus_words(df, ["d"])
    monkeypatch.setattr(tfidf, "term_array", None)
    vocab = tfidf.corpus_vocabulary(df, max_features=features, words=words)
    assert {r.term: r.df for r in vocab.collect()} == {w: seen[w] for w in want}
    idf = {r.term: r.idf for r in vocab.collect()}
    raw = [{w: t.count(w) * idf[w] for w in set(t) & set(want)} for t in terms]
    unit = {(i if i < 32 else 99, w): v / sum(x * x for x in r.values()) ** 0.5 for i, r in enumerate(raw) for w, v in r.items()}
    assert {(r.d, r.term): r.w for r in tfidf.corpus_weights(df, "d", vocab, words=words).collect()} == pytest.approx(unit)
    vectors = {r.d: r.vec for r in tfidf.corpus_vectors(words, "d", vocab).collect()}
    assert len(vectors) == 33 and vectors[99] is None
    assert all(v is None or v == pytest.approx([unit.get((d, w), 0.0) for w in sorted(want)]) for d, v in vectors.items())


def test_texts_of_a_hot_group_stay_where_they_are(spark):
    """The row of a hot group goes to its texts, not all of them to one task; small groups are joined as well."""
    rows = spark.range(0, 6000, 1, 8).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("g"), "id")).alias("g"), "id")
    small = rows.select("g").distinct().withColumn("v", F.concat("g", F.lit("!")))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = tfidf.with_group_row(rows, small, ["g"]).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sorted(r.id for r in out) == list(range(6000)) and all(r.v == r.g + "!" for r in out)
    assert len({r.part for r in out if r.g == "hot"}) > 3
