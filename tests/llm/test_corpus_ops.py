"""Near duplicates, mixing, decontamination, language model scores, and the pipeline."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tabloom.llm import bitpack, decontaminate, gated_lm, language_id, mixing, simhash
from tabloom.llm.components import components


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


# -- SimHash


def brute_fingerprint(text):
    w = words_of(text)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    v = np.array(fps, np.uint64)
    for k in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(v[k + 1 :] ^ v[k]) <= 4)[0].tolist():
            a, b = find(k), find(k + 1 + j)
            parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def test_masks_cover():
    masks = simhash.masks()
    r = random.Random(5)
    assert len(masks) == 31
    for _ in range(3000):
        d = sum(1 << i for i in r.sample(range(64), 4))
        first = next(m for m in masks if not m & d)
        assert any(not m & d for m in simhash.second_masks(first))
    assert all(64 - m.bit_count() <= 18 for x in masks for m in simhash.second_masks(x))


@pytest.mark.parametrize("hot", [simhash.HOT, 1])
def test_near_duplicates_by_brute_force(spark, sf, odd, hot):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        docs = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0))
        fps = [brute_fingerprint(t) for _, t in docs]
        want = sorted(((d, f, docs[c][0]) for (d, _), f, c in zip(docs, fps, brute_components(fps), strict=True)), key=str)
        got = [(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(df, hot=hot).collect()]
        assert sorted(got, key=str) == want


def test_chain_of_fingerprints(spark):
    r = random.Random(1)
    x, chain = r.getrandbits(64), []
    for _ in range(300):
        chain.append(x)
        for i in r.sample(range(64), 4):
            x ^= 1 << i
    signed = [c - (1 << 64) if c >> 63 else c for c in chain]
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"))
    assert components(edges).select("root").distinct().count() == 1 and components(edges).count() == 300


def test_empty_near_duplicates(empty):
    assert simhash.near_duplicates(empty).count() == 0


# -- mixing


def test_mix_against_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = mixing.op7_poisson_mix(spark, sf).select("doc_id", "copy", "shuffle_key").collect()
    assert sorted(map(tuple, rows)) == sorted(c.sql(f"SELECT doc_id, copy, shuffle_key FROM ({mixing.OP7_SQL})").fetchall())
    assert [r["shuffle_key"] for r in rows] == sorted(r["shuffle_key"] for r in rows)


def test_draws_are_poisson(spark):
    n, mean = 20_000, 37.5
    df = spark.range(n).selectExpr("id AS doc_id", "'t' AS text", "'s' AS source")
    got = [r["count"] for r in mixing.mix(df, {"s": 1.0}, rows=n * mean).groupBy("doc_id").count().collect()]
    assert abs(sum(got) / n - mean) < 0.3 and abs(np.var(got) / mean - 1) < 0.06


def test_mix_rates_and_odd_rows(odd, empty, monkeypatch):
    want = sorted((r["doc_id"], r["copy"]) for r in mixing.mix(odd.where("doc_id is not null"), {"a": 3.0, "b": 1.0}, rows=40).collect())
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)  # the salted join gives the same
    got = mixing.mix(odd.where("doc_id is not null"), {"a": 3.0, "b": 1.0}, rows=40)
    assert sorted((r["doc_id"], r["copy"]) for r in got.collect()) == want and {r["source"] for r in got.collect()} <= {"a", "b"}
    assert mixing.mix(odd).columns[-2:] == ["copy", "shuffle_key"] and mixing.mix(empty).count() == 0 and mixing.mix(odd, {}).count() == 0
    assert mixing.rates({"a": 10, "b": 30}, {"a": 1.0, "b": 1.0}) == {"a": 2.0, "b": 40 / 2 / 30}


def brute_copies(doc_id, mean):
    """The Poisson draw of a document, by the plain inversion."""
    pieces = max(1, math.ceil(mean / 16))
    term = total = math.exp(-mean / pieces)
    sums = [total]
    for k in range(1, 96):
        term *= mean / pieces / k
        sums.append(total := total + term)
    draws = ((int(hashlib.md5(f"mix-1:{'' if doc_id is None else doc_id}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in range(1, pieces + 1))
    return sum(sum(x <= u for x in sums) for u in draws)


def test_mix_of_odd_rows_by_brute_force(odd):
    docs = [(r["doc_id"], r["source"]) for r in odd.collect()]
    rate = mixing.rates(collections.Counter(s or "" for _, s in docs), rows=400)
    want = collections.Counter()
    for i, s in docs:
        want[i] += brute_copies(i, rate[s or ""])
    got = mixing.mix(odd, rows=400).collect()
    assert collections.Counter(r["doc_id"] for r in got) == +want and want[None] and [r["shuffle_key"] for r in got] == sorted(r["shuffle_key"] for r in got)


# -- decontamination


def brute_words(text):
    return re.findall(r"\w+", (text or "").lower())


def brute_shingles(w):
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_leak(item, text):
    """Whether an item contaminates a text: written anew, with no part of the operator."""
    w, have = brute_words(item), brute_words(text)
    if not w or not have:
        return False
    if len(w) < 5:
        return w == have
    held = brute_shingles(have)

    def share(part):
        own = brute_shingles(part)
        return len(own & held) / len(own) >= 0.8

    cuts = [k + 1 for k, c in enumerate(item) if c in ".!?\n" and brute_words(item[: k + 1]) and brute_words(item[k + 1 :])]
    if cuts:
        cut = sorted(cuts, key=lambda k: (abs(k - len(item) / 2), k))[0]
        q, a = brute_words(item[:cut]), brute_words(item[cut:])
    else:
        q, a = w[: (len(w) + 1) // 2], w[(len(w) + 1) // 2 :]
    return share(w) or (len(q) >= 5 <= len(a) and share(q) and share(a))


def test_contaminated_by_brute_force(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet").collect(), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(r["doc_id"], i["item_id"]) for r in docs for i in items if brute_leak(i["text"], r["text"])}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.op8_decontaminate(spark, sf).collect()} == want and want


@pytest.mark.parametrize("gap", [0, 20, 60, 150, 300, 2000])
def test_question_and_answer_far_apart(spark, gap):
    r = random.Random(gap)
    word = lambda: "".join(r.choices("abcdefghijkl", k=r.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(22)) + ". " + " ".join(word() for _ in range(18))) for k in range(100)]
    texts = []
    for _, text in items:
        q, a = text.split(". ")
        texts.append(" ".join([*(word() for _ in range(r.randint(0, 90))), q, *(word() for _ in range(gap)), a, *(word() for _ in range(40))]))
    half = [(1000 + k, text.split(". ")[0] + " " + " ".join(word() for _ in range(60))) for k, text in items]
    docs = spark.createDataFrame([*enumerate(texts), *half], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((x["doc_id"], x["item_id"]) for x in got.collect()) == [(k, k) for k in range(100)]


def test_short_items_need_their_whole(spark):
    items = spark.createDataFrame([(1, "yes"), (2, "Oh yes!"), (3, "one two three four five six"), (None, "a b c d e f g")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "oh yes indeed it is"), (2, "YES"), (3, "oh, yes."), (4, "and one two three four five six too"), (5, "one two three and four five six"), (6, "x a b c d e f g")], "doc_id long, text string")
    assert sorted(((x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs, items).collect()), key=str) == [(2, 1), (3, 2), (4, 3), (6, None)]


def test_search_finds_all_above_the_threshold():
    d, r = decontaminate, random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30)))) for k in range(80)]
    cut = [p for _, t in items for p in d.passages(t)]
    df = collections.Counter(w for p in cut for w in set(p))
    stats = d.Statistics(len(cut), sum(map(len, cut)) / len(cut), df)
    index = d.Index(items, stats)
    for _ in range(200):
        q = [r.choice(vocabulary) for _ in range(25)]
        want = set()
        for k, (_, t) in enumerate(items):
            for p in d.passages(t):
                norm = d.K1 * (1 - d.B + d.B * len(p) / stats.mean)
                tf = collections.Counter(p)
                impact = {w: stats.idf(w) * f * (d.K1 + 1) / (f + norm) for w, f in tf.items()}
                if sum(impact[w] for w in set(q) if w in impact) / sum(impact.values()) >= 0.4:
                    want.add(k)
        assert index.retrieve(q, 0.4) == want


def test_indexes_and_passes_give_the_same(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contaminated(docs, items).select("doc_id", "item_id").collect()))
    blocks = decontaminate.contaminated(docs, items, size=16)
    assert sorted(map(tuple, blocks.select("doc_id", "item_id").collect())) == want
    assert blocks._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    monkeypatch.setattr(decontaminate.passes, "__defaults__", (4000,))
    assert sorted(map(tuple, decontaminate.contaminated(docs, items).select("doc_id", "item_id").collect())) == want


def test_decontaminate_odd_documents(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "The same text of the day, and more."), (3, "The same text of the day, and more.")], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.contaminated(odd, items).select("doc_id", "item_id").collect())) == [(5, 3)] * 2 + [(6, 3)] * 4
    assert decontaminate.clean(odd, items).count() == 9 and decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.clean(odd, items.where("1 = 0")).count() == 12 and decontaminate.contaminated(empty, items).count() == 0


# -- language model


def test_gradients():
    v = gated_lm.Vocabulary([("a", 9), ("\n", 7), ("b", 5), ("c", 2)], [("xy", 4), ("", 3)])
    m = gated_lm.Gru(v, hidden=5)
    rng = np.random.default_rng(0)
    for k in m.p:
        m.p[k] = (m.p[k] + rng.standard_normal(m.p[k].shape) * 0.3).astype(np.float64)
    classes = np.concatenate([v.head_class, np.arange(v.classes)])
    target = rng.choice([0, 1, 2, 3, 4 + v.heads], (3, 6))
    before = np.concatenate([np.full((3, 1), 1), target[:, :-1]], axis=1)

    def loss():
        h, total = np.zeros((3, 5)), 0.0
        for t in range(6):
            h = np.where((before[:, t] == 1)[:, None], 0.0, h)
            h = m.step(m.p["X"][before[:, t]], h)
            total -= m.log_probs(h, target[:, t], classes[target[:, t]], np.zeros(3)).sum()
        return total / 3

    _, grads = m._window(before, target, classes, np.zeros((3, 5)), 1)
    for k, g in grads.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in g.shape)
            old = m.p[k][at]
            m.p[k][at] = old + 1e-5
            up = loss()
            m.p[k][at] = old - 1e-5
            down = loss()
            m.p[k][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4, k


def test_probabilities_add_up():
    words = {"a": 9, "\n": 7, "b": 5, "zxy": 3, "wxy": 0 + 1, "q": 2}
    v = gated_lm.Vocabulary([("a", 9), ("\n", 7), ("b", 5)], [("xy", 3 + 1 + 1 + 1), ("q", 3)])
    m = gated_lm.Gru(v, hidden=4)
    m.p["C"] += np.float32(0.3)
    inputs, classes = v.of(list(words))
    shares = np.array([0.0 if c < v.heads else math.log(words[w] + 1) - math.log(v.mass[c]) for w, c in zip(words, classes, strict=True)])
    state = np.full((len(words), 4), 0.2, np.float32)
    total = np.exp(m.log_probs(state, inputs, classes, shares)).sum()
    unknown = sum(math.exp(m.class_logs(state[:1])[0, c]) / v.mass[c] for c in range(v.heads, v.classes))
    assert abs(total + unknown - 1) < 1e-5


def test_lanes_score_like_single_documents():
    v = gated_lm.Vocabulary([("a", 9), ("\n", 7), ("b", 5)], [("xy", 6)])
    m = gated_lm.Gru(v, hidden=6)
    words = ["a", "b", "zxy", "other", "\n"]
    inputs, classes = v.of(words)
    shares = np.where(classes >= v.heads, -1.5, 0.0)
    r = random.Random(4)
    docs = [[r.randrange(4) for _ in range(r.randint(0, 60))] + [4] for _ in range(40)]
    flat, lengths = np.concatenate([np.array(d) for d in docs]), np.array([len(d) for d in docs])
    got = m.score(flat, inputs, classes, shares, lengths, lanes=7, steps=5)
    alone = [m.score(np.array(d), inputs, classes, shares, np.array([len(d)]))[0] for d in docs]
    assert np.allclose(got, alone, atol=1e-4)


def test_scores_by_brute_force(spark, sf, odd, empty):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        docs = [(r["doc_id"], r["text"]) for r in df.collect()]
        tokens = [[*words_of(t), None] for _, t in docs]
        crc = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 for i, _ in docs]
        counts = collections.Counter(w for t, k in zip(tokens, crc, strict=True) if k != 2 for w in t)
        n, v = sum(counts.values()), len(counts)
        want = sorted(((i, k == 2, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 5)) for (i, _), t, k in zip(docs, tokens, crc, strict=True)), key=str)
        got = gated_lm.score_documents(df, block=5000).collect()
        assert sorted(((*tuple(r)[:5], round(r["base_score"], 5)) for r in got), key=str) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert gated_lm.score_documents(empty).count() == 0


def test_model_beats_the_base_on_held_out_text(spark, sf):
    held = [r for r in gated_lm.op2_gated_lm(spark, sf).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


# -- pipeline


def test_one_row_of_each_group_whatever_the_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(1, a, "x"), (1, b, "y"), (None, c, "z"), (None, d, "w"), (-1, d, "v"), (5, a, "u"), (1, a, "x"), (None, None, "n"), (7, "", "e"), (8, None, "f")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, a), (1, b), (None, c), (-1, d), (7, "")], key=str)


def brute_groups(texts):
    """Whether each text is the first of its group: groups are what pairs of a Jaccard index of five-word shingles of 0.8 or more connect."""
    sets = [brute_five(t) for t in texts]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for b, y in enumerate(sets):
        for a, x in enumerate(sets[:b]):
            if 5 * len(x & y) >= 4 * len(x | y) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) == k for k in range(len(sets))]


def brute_five(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_by_brute_force(spark, sf):
    docs = sorted(((r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()))
    samples = language_id.learn(spark.read.parquet(f"{sf}/documents.parquet").where(~language_id.held_out()))
    told = language_id.Model(samples).predict([t for _, t, _ in docs])
    docs = [d for d, (lang, score) in zip(docs, told, strict=True) if lang != "und" and score >= 0.01]
    docs = [d for d, first in zip(docs, brute_groups([d[1] for d in docs]), strict=True) if first]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [x for x in docs if not any(brute_leak(i, x[1]) for i in items)]
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR, lang VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, '', 0)", docs)
    copies = [r[0] for r in c.sql(f"SELECT doc_id FROM ({mixing.OP7_SQL}) ORDER BY doc_id").fetchall()]
    text = {i: t for i, t, _ in docs}
    enc, at, want = bitpack.Encoder(bitpack.tokenizer_path("word_bpe_49k.json")), 0, []
    for i in copies:
        ids = [*enc.library.encode(text[i], add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=lambda r: r[1]) == want


def test_language_stage_rejects_and_writes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**9 + k, t, None, "s", 1) for k, t in enumerate((None, "", "123 !", "Q"))], docs.schema)
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs.unionByName(odd), sf).collect()}
    samples = language_id.learn(docs.where(~language_id.held_out()))
    told = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language_id.predicted(docs, samples).collect()}
    assert kept == {k: lang for k, (lang, score) in told.items() if lang != "und" and score >= corpus_pipeline.TOLD}


def test_stages_take_odd_documents(spark, sf, odd, empty):
    """Every stage, run on nulls, empties, a long text, ties, repeated rows and on no rows at all."""
    five = ["doc_id", "text", "lang", "source", "n_chars"]
    want = {"language_id": None, "near_dedup": 8, "decontaminate": 12, "mix_sources": None, "token_ids": 12}
    for df, rows in ((odd.select(*five), 12), (empty.select(*five), 0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, df, sf)
            found = got.collect()
            assert name == "token_ids" or got.columns == five, name
            assert not rows or want[name] is None or len(found) == want[name], name
            assert rows or not found, name
    told = corpus_pipeline.language_id(spark, odd.select(*five), sf).collect()
    assert {r["doc_id"] for r in told} >= {4, 5, 6} and not {r["doc_id"] for r in told} & {1, 2, 3, 9}
