"""The pipeline's near duplicates: five-word shingles, Jaccard index 0.8."""

import numpy as np
import pytest
import xxhash
from test_corpus_ops import words_of

import corpus_pipeline
from tabloom.llm import near_copies, shared


def brute_shingles(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_groups(sets):
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for b, y in enumerate(sets):
        for a, x in enumerate(sets[:b]):
            if (5 * len(x & y) >= 4 * len(x | y)) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(sets))]


def kept_by_brute_force(docs):
    groups = brute_groups([brute_shingles(t) for _, t in docs])
    return [d for k, d in enumerate(docs) if groups[k] == k]


def made(words_apart):
    """A text of 100 words and copies of it, each further one with another word replaced."""
    w = [f"w{k}" for k in range(100)]
    out = [" ".join(w)]
    for k in range(words_apart):
        w = [*w]
        w[11 * k + 5] = f"other{k}"
        out.append(" ".join(w))
    return out


def test_stage_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = kept_by_brute_force(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == want


@pytest.mark.parametrize("hot", [near_copies.HOT, 2])
def test_chains_and_blocks(spark, hot):
    texts = [*made(8), "a b", "A  b", "", None, "one two three four five six"]
    docs = list(enumerate(texts))
    got = near_copies.one_of_each(spark.createDataFrame(docs, "doc_id long, text string"), hot)
    assert sorted(map(tuple, got.collect())) == kept_by_brute_force(docs)


def test_stage_keeps_rows_without_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(1, a, "x"), (1, b, "y"), (None, c, "z"), (None, d, "w"), (-1, d, "v"), (5, a, "u"), (1, a, "x"), (None, None, "n"), (7, "", "e"), (8, None, "f")]
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, a), (1, b), (None, c), (-1, d), (7, "")], key=str)


def test_simhash_parts_by_brute_force():
    """Each part is the majority of the shingles' mixed hashes, ties by the least hash."""
    for n in (1, 2, 5, 300, 512):
        hashes = np.unique(np.array([xxhash.xxh64_intdigest(str(k)) for k in range(n)], np.uint64))
        own = hashes if n % 2 else np.concatenate([hashes, hashes[:1]])
        for part, got in enumerate(near_copies.simhash_parts(hashes).view(np.uint64).tolist()):
            x = near_copies.mixed(own ^ near_copies._KEYS[part]).tolist()
            assert got == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in x) > len(x))
    assert len(near_copies.simhash_parts(np.zeros(0, np.uint64))) == 0


@pytest.mark.parametrize(("room", "few"), [(near_copies.ROOM, near_copies.FEW), (70, 1)])
def test_candidates_are_covered(spark, monkeypatch, room, few):
    """Fingerprints that a part's masks cover are connected, whatever the ranges and however buckets are searched; unlike ones are not."""
    monkeypatch.setattr(near_copies, "FEW", few)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, (40, near_copies.PARTS), np.uint64)
    prints = [p.copy() for p in base for _ in range(5)]
    for k, p in enumerate(prints):
        if k % 5:  # 4 differing bits of one part, far more in all others
            part = k % near_copies.PARTS
            p ^= rng.integers(0, 1 << 64, near_copies.PARTS, np.uint64)
            bits = rng.choice(near_copies.BITS, near_copies.RADIUS, replace=False)
            p[part] = base[k // 5][part] ^ np.uint64(sum(1 << int(b) for b in bits))
            p[(part + 1) % near_copies.PARTS] = base[k // 5][(part + 1) % near_copies.PARTS]
    classes = spark.createDataFrame([(k, p.view(np.int64).tolist()) for k, p in enumerate(prints)] + [(-1, [])], "set_hash long, prints array<long>")
    found = [tuple(r) for r in near_copies.candidates(classes, room).collect()]
    assert all(a // 5 == b // 5 for a, b in found)
    root = list(range(len(prints)))
    for _ in range(5):
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
    assert root == [k - k % 5 for k in range(len(prints))]


def test_pairs_at_the_threshold(spark):
    """Sets of an index of exactly 0.8: 200 pairs, whose edits stand together, so that words help no more than shingles."""
    prints = []
    for k in range(200):
        hashes = np.unique(np.random.default_rng(k).integers(0, 1 << 64, 100, np.uint64))
        prints += [near_copies.simhash_parts(hashes[:90]), near_copies.simhash_parts(hashes[10:])]
    found = near_copies.candidates(spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(prints)], "set_hash long, prints array<long>"))
    assert sorted(map(tuple, found.collect())) == [(2 * k, 2 * k + 1) for k in range(200)]


def test_workers_give_memory_back(monkeypatch):
    """A worker that turns to another operator gives the last one's memory back, once."""
    calls = []
    monkeypatch.setattr(shared, "_KEPT", {})
    monkeypatch.setattr(shared, "given_back", lambda: calls.append(1))
    for key in ("a", "a", "b", "b"):
        assert shared.kept(key, lambda: [key]) == [key]  # noqa: B023
    assert calls == [1]


def test_edges_of_a_large_group(spark):
    """A group in which every mask finds pairs gives about as many edges as it has members, not as many for each mask and part."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, near_copies.PARTS, np.uint64)
    prints = [base ^ (np.uint64(1) << rng.integers(0, 48, near_copies.PARTS, np.uint64)) for _ in range(400)]
    classes = spark.createDataFrame([(k - 200, p.view(np.int64).tolist()) for k, p in enumerate(prints)], "set_hash long, prints array<long>")
    found = sorted(map(tuple, near_copies.candidates(classes).collect()))
    assert {b for _, b in found} == set(range(-199, 200)) and len(found) < 2 * 400


def test_joined_by_brute_force():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (50, 20), (300, 290)):
        pairs, root = rng.integers(0, n, (m, 2)), np.arange(n)
        for some in np.array_split(pairs, 3):
            root = near_copies.joined(root, some)
        want = list(range(n))
        for _ in range(n):
            for a, b in pairs.tolist():
                want[a] = want[b] = min(want[a], want[b])
        assert root.tolist() == want


def test_only_texts_of_candidates_are_moved(spark):
    rows = [(k if k % 7 else None, f"text {k}") for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    on = ["z", "id", "text_hash"]
    keyed = docs.selectExpr("text", "doc_id is null as z", "coalesce(doc_id, 0) as id", "xxhash64(text) as text_hash")
    member = keyed.where("text in ('text 0', 'text 9', 'text 14', 'text 4999')").selectExpr("text_hash as node", "1L as root", "4L as m", *on)
    passed = {r["text"] for r in near_copies.sifted(keyed, member, on).collect()}
    assert passed >= {"text 0", "text 9", "text 14", "text 4999"} and len(passed) < 50
    assert near_copies.sifted(keyed, member.where("1 = 0"), on).count() == 0
    twice = docs.unionByName(docs)  # repeated rows are one text
    assert sorted(r["text"] for r in near_copies.texts_of(member, twice).collect()) == ["text 0", "text 14", "text 4999", "text 9"]


def test_large_groups_meet_in_rounds(spark):
    """The first round reads a group in proportion to its size; after it every pair meets but those of the largest linked set."""
    n, hot = 1000, 20
    text = spark.range(n).selectExpr("id as node", "7L as root", f"{n}L as m", "'' as text")
    assert near_copies.first_round(text, hot).count() < 3 * n
    told = spark.range(n).selectExpr("id as node", "7L as root", "1L as label")
    assert near_copies.second_round(told, hot) is None
    nodes = range(60)
    label = {k: 0 if k < 35 else 35 if k < 50 else k for k in nodes}
    told = spark.createDataFrame([(k, r, label[k] if r else 0) for k in nodes for r in (0, 1)], "node long, root long, label long")
    tasks = {}
    for r in near_copies.second_round(told, hot).collect():
        assert r["root"] == 1
        tasks.setdefault((r["x"], r["y"]), set()).add(r["node"])
    met = {(a, b) for t in tasks.values() for a in t for b in t}
    assert all((a, b) in met for a in nodes for b in nodes if a != b and not label[a] == label[b] == 0)
    assert max(map(len, tasks.values())) <= 2 * hot


def test_sets_apart_in_one_group(spark):
    """Two sets of linked texts and single ones, candidates of each other: rows that stay are those of brute force, whatever the block's size."""
    texts = made(7)
    w = texts[0].split()
    for start in (0, 30, 60):  # 12 words apart from the first, less than 0.8 alike
        own = [*w]
        own[start : start + 24 : 2] = [f"far{start}-{k}" for k in range(12)]
        texts += [" ".join(own), " ".join([*own[:-1], "end"])]
    docs = [(k, t) for k, t in enumerate(texts)]
    got = near_copies.one_of_each(spark.createDataFrame(docs, "doc_id long, text string"), 4)
    assert sorted(map(tuple, got.collect())) == kept_by_brute_force(docs)
