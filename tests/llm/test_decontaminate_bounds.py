"""Decontamination looks up windows of a document only for items that its words could contaminate it with."""

import collections
import random

from tabloom.llm import decontaminate as d


def index_of(items):
    cut = [p for _, t in items for p in d.passages(t)]
    return d.Index(items, d.Statistics(len(cut), sum(map(len, cut)) / len(cut), collections.Counter(w for p in cut for w in set(p))))


def test_no_search_for_items_out_of_reach(monkeypatch):
    r = random.Random(5)
    common = [f"w{k}" for k in range(30)]
    items = [(k, " ".join([*r.choices(common, k=24), *(f"rare{k}x{j}" for j in range(4)), *r.choices(common, k=12), f"end{k}"])) for k in range(120)]
    index, asked, search = index_of(items), [], d.Index.search
    monkeypatch.setattr(d.Index, "search", lambda self, *a: asked.append(a) or search(self, *a))
    # most of an item's weight, in whatever order, without enough of its shingles' words
    for _, text in items:
        w = d.words(text)
        assert index.contaminating(r.sample([x for x in w if x not in (w[24], w[27])] * 3, 90), d.THRESHOLD, d.OVERLAP) == []
    assert not asked
    for k, text in items:
        w = [*r.choices(common, k=700 + k), *d.words(text), *r.choices(common, k=300)]
        assert [x[0] for x in index.contaminating(w, d.THRESHOLD, d.OVERLAP)] == [k]
    assert asked


def test_contaminating_is_retrieval_and_overlap():
    """Whatever is left out beforehand: the same as all retrieved items, each held against the whole document."""
    r = random.Random(8)
    common = [f"w{k}" for k in range(200)]
    items = [(k, " ".join(r.choices(common, k=r.randint(1, 40))) + r.choice([". ", " "]) + " ".join(r.choices(common, k=r.randint(0, 30)))) for k in range(60)]
    index, hit = index_of(items), 0
    for n in range(60):
        near = d.words(r.choice(items)[1])
        for _ in range(r.randint(0, 4)):
            near[r.randrange(len(near))] = r.choice(common)
        w = [*r.choices(common, k=r.choice([0, 40, 1100])), *near, *r.choices(common, k=r.choice([0, 9, 300]))]
        want = []
        for k in sorted(index.retrieve(w, 0.6)):
            shares = [sum(s in d.shingles(w, len(s)) for s in p) / len(p) if p else 0.0 for p in index.parts_of(k)]
            sizes = [len(next(iter(p), ())) for p in index.parts_of(k)]
            if w == d.words(items[k][1]) if sizes[2] < 5 else shares[2] >= 0.8 or (min(shares[:2]) >= 0.8 and min(sizes[:2]) >= 5):
                want.append((k, *shares[:2]))
        assert index.contaminating(w, 0.6, 0.8) == want
        hit += len(want)
    assert hit > 20


def test_words_of_every_character():
    r = random.Random(3)
    texts = ["a" + chr(c) + "B" + chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts += ["".join(chr(r.randrange(256)) for _ in range(200)) for _ in range(200)] + ["ΑΣ. ΟΔΟΣ", "İI", "\x85\xa0\x1cÀ_²ªß", "", None]
    assert [d.words(t) for t in texts] == [d._WORD.findall((t or "").lower()) for t in texts]
