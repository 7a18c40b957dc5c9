"""HTML extraction, token counts, packed ids, language id, fingerprints, personal data."""

import collections
import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pytest

from tabloom.llm import bitpack, html_text, language_id, pii, spotsigs, token_counts
from tabloom.llm.bitpack import tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
PARTS = ["a", "B", " ", "  ", "\n", "é", "é", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "1", "\x1c", "\x85", "\xa0", " ", "ß", "Σ", "σ", "İ", "中文", "🦆", "\t", ".", "!!", "the", "tion", "\x00", "_", ".,", "word.", "ŉ", "²"]


def strings(n, seed, most=60):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, most))) for _ in range(n)]


# -- pages


def test_pages_by_brute_force(spark, sf):
    got = {r["page_id"]: r for r in html_text.op1_html_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[a-z/][^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def article_of(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[a-z/][^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


def unnamed(page):
    """The page with every element and attribute that names a role made nameless."""
    return re.sub(r"\s(class|id|role)=\"[^\"]*\"", "", re.sub(r"<(/?)(article|nav|header|footer|aside|main|form)\b[^>]*>", r"<\1div>", page))


@pytest.mark.parametrize(("strip", "exact", "precise"), [(unnamed, 0.85, 0.99), (lambda p: unnamed(re.sub("</?article>", "", p)), 0.55, 0.98)])
def test_the_distribution_finds_articles_without_role_markup(spark, strip, exact, precise):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want, got = [article_of(p).split() for p in pages], [html_text.main_text(strip(p)).split() for p in pages]
    shared = [sum((collections.Counter(a) & collections.Counter(b)).values()) for a, b in zip(want, got, strict=True)]
    assert sum(map(len, want)) * 0.99 <= sum(shared) and sum(map(len, got)) * precise <= sum(shared)
    assert sum(a == b for a, b in zip(want, got, strict=True)) >= exact * len(pages)


def test_surge_and_window_decide(spark):
    pages = [unnamed(re.sub("</?article>", "", r["html"])) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    own = [html_text.main_text(p) for p in pages]
    assert all(sum(html_text.main_text(p, **k) != t for p, t in zip(pages, own, strict=True)) > 0.2 * len(pages) for k in ({"surge": 1}, {"window": 1, "surge": 1}))
    assert any(html_text.main_text(p, 50, 10**9) != t for p, t in zip(pages, own, strict=True))


def test_short_lines_of_the_article_stay():
    long, links, short = f"<p>{'Words of the text. ' * 8}</p>", "<p><a href=x>a link</a></p>" * 3, "<p>Its short last paragraph.</p>"
    for page in (long + links + short, f"<div>{long}{links}{short}</div>", f"<div>{short}{long}<ul><li>one<li>two</ul>{short}</div><div><ul><li><a>menu</a><li><a>more</a></ul></div>"):
        got = html_text.main_text(page)
        assert got.endswith("Its short last paragraph.") and "menu" not in got and got.count("Words") == 8


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "</p>" * 60_000, "<p><div>" * 60_000, "<a>" * 100_000 + "<hr>" * 100_000, "<iframe>" * 120_000, '<p title="' * 100_000, "<" * 1_000_000])
def test_pages_take_time_in_proportion_to_their_length(page):
    def took(p):
        began = time.process_time()
        html_text.main_text(p)
        return time.process_time() - began

    assert took(page) < 6 * took(page[: len(page) // 2]) + 1  # a quadratic scan of these takes minutes


def test_page_without_article():
    page = (
        '<body><div id="menu"><a href=x>Home</a> <a>About</a></div><header>Site</header><div id=content><h1>A title</h1><p>Text that is long enough to be the article of this page, and goes on so that it surges.</p>'
        '<p>Yes.</p><div class="ad-box">Buy</div><form>Name <input></form><p>More &eacute;&nbsp;x &lt;b&gt;.</p></div><div class="comments"><article>first!</article></div><aside>side</aside><footer>c</footer>'
    )
    assert html_text.main_text(page) == "A title Text that is long enough to be the article of this page, and goes on so that it surges. Yes. More é x <b>."


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<script>x</script>", ""), ("<article><p>a<p>b<br>c", "a b c"), ('<article><p title="a>b">q</p></article>', "q"), ('<p title="never closed>q', "q"), ("<" * 5000, "<" * 5000)])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (2, None, "<p>hi there", "t"), (2, None, "<p>hi there", "t")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text.extract(df).collect()), key=str) == [(1, "u", "", 0), (2, None, "hi there", 8), (2, None, "hi there", 8)]
    assert html_text.extract(df.where("1 = 0")).count() == 0


# -- tokens


def test_runs_are_the_librarys_ids():
    enc = bitpack.Encoder(WORD)
    texts = strings(3000, 1)
    want = enc.library.encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in enc.encode(texts)] == [x.ids for x in want]


def test_runs_out_of_normal_form():
    """Letters that normalisation takes apart join the mark after them; every character of the first planes, and long mixtures."""
    enc, r = bitpack.Encoder(WORD), random.Random(9)
    low = [chr(c) for c in range(0x20, 0x10000) if not 0xD800 <= c < 0xE000]
    letters, marks = [c for c in low if c.isalpha()], [*" .,;:!?*#%&$"]
    texts = ["\u091c\u095c,", "\u0917\u095d.", "\u09ac\u09dc,", "\u0a16\u0a59,", "\u0b15\u0b5c;", "\u05d0\ufb2a,", "\ufb2e.", *[f"a{c}, {c}.*b" for c in low]]
    texts += ["".join(r.choice(kind if r.random() < 0.65 else marks) for _ in range(r.randint(1, 14))) for kind in (low, letters) for _ in range(20_000)]
    for a in range(0, len(texts), 20_000):
        some = texts[a : a + 20_000]
        assert [x.tolist() for x in enc.encode(some)] == [x.ids for x in enc.library.encode_batch_fast(some, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31])
def test_pack(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1003, dtype=np.uint64)
    assert (bitpack.unpack(bitpack.pack(ids, bits), 1003, bits) == ids).all()


def test_random_access():
    docs = [np.arange(n, dtype=np.uint32) % 49408 for n in (0, 5, 70000, 131, 1)]
    shard = bitpack.Shard(bitpack.shard_bytes(docs, 49408, block=1000))
    assert shard.bits == 16 and all((shard.document(k) == d).all() for k, d in enumerate(docs))
    with pytest.raises(ValueError):
        bitpack.pack(np.array([4]), 2)


def test_packed_documents(spark, odd, empty):
    lib = bitpack.Encoder(WORD).library
    got = sorted(map(tuple, bitpack.packed_digest(odd, WORD).collect()), key=lambda r: r[1])
    at = 0
    for r, (doc_id, text) in zip(got, sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])), strict=True):
        ids = [*lib.encode(text, add_special_tokens=False).ids, 1]
        assert r == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert bitpack.packed_digest(empty, WORD).count() == 0


def test_chunks_are_the_librarys_count():
    c = token_counts.Counter(BYTE, chunk=24, overlap=6)
    texts = strings(2000, 2)
    assert c.counts(texts) == [len(x.ids) for x in c.library.encode_batch(texts, add_special_tokens=False)]
    assert c.counts(["x" * 500]) == [len(c.library.encode("x" * 500).ids)]
    r, low = random.Random(4), [chr(k) for k in range(0x20, 0x3100)]
    texts += ["".join(r.choice(low if r.random() < 0.3 else PARTS) + r.choice(["", "", " ", "\n", "  "]) for _ in range(r.randint(0, 50))) for _ in range(4000)]
    texts += [f"a {k} b{k}c {k}" for k in low]
    for whole in (token_counts.Counter(BYTE), token_counts.Counter(BYTE, chunk=100, overlap=20)):
        assert whole.counts(texts) == [len(x.ids) for x in c.library.encode_batch(texts, add_special_tokens=False)]


def test_counts_of_documents(odd, empty):
    lib = bitpack.Encoder(BYTE).library
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(lib.encode(r["text"] or "").ids), n > 512) for r in odd.collect()), key=str)
    assert sorted(map(tuple, token_counts.count_tokens(odd, BYTE).collect()), key=str) == want
    assert token_counts.count_tokens(empty, BYTE).count() == 0


def test_sentencepiece_counts():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts.Counter(path).counts(["", "one two"]) == [0, len(sp.encode("one two"))]


# -- languages


def test_automaton_knows_every_substring():
    text = [1, 2, 1, 1, 3, 2, 1, 1]
    a = language_id.Automaton(text)

    def accepts(seq):
        state = 0
        for c in seq:
            if c not in a.next[state]:
                return False
            state = a.next[state][c]
        return True

    subs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
    assert all(accepts(s) for s in subs) and not accepts([3, 3]) and not accepts([2, 2])


@pytest.mark.parametrize(("dense", "window"), [(48, 8192), (5, 3), (2, 7)])
def test_phrases_by_brute_force(monkeypatch, dense, window):
    """Also with most letters outside the tables, and with texts of many windows."""
    monkeypatch.setattr(language_id, "DENSE", dense)
    monkeypatch.setattr(language_id, "WINDOW", window)
    samples = {"a": "the cat sat on the mat and ran", "b": "le chat est sur la natte et dort"}
    m = language_id.Model(samples)
    texts = ["the chat", "cat sat le natte", "zzz", "t", "sur the la on mat q and", "the cat sat on the mat and ran le chat est sur la natte et dort zz the cat sat on the mat"]
    together = m.phrases([m.codes[language_id.points(t)] for t in texts])
    for i, text in enumerate(texts):
        for k, lang in enumerate(m.languages):
            at, n = 0, 0
            while at < len(text):
                size = 0
                while at + size < len(text) and text[at : at + size + 1] in samples[lang]:
                    size += 1
                at, n = at + max(1, size), n + 1
            assert together[i][k] == n, (text, lang)


def test_languages_of_thousands_of_signs():
    """Three languages that share their 2,500 signs beside two of Latin letters: no sign is left out of the fit."""
    r = random.Random(6)

    def tongue(signs, blank):
        order = r.sample(signs, len(signs))
        pairs = [a + b for a, b in zip(order, r.sample(order, len(order)), strict=True)]
        weight = [1 / (k + 3) for k in range(len(order))]
        return lambda n: blank.join(r.choices(order, weight, k=n // 2) + r.choices(pairs, weight, k=n // 4))

    signs, latin = [chr(0x4E00 + 3 * k) for k in range(2500)], ["".join(r.choices("abcdefghijklmno", k=r.randint(2, 7))) for _ in range(900)]
    tongues = {"x1": tongue(signs, ""), "x2": tongue(signs, ""), "x3": tongue(signs[:1800] + [chr(0x3041 + k) for k in range(80)] * 3, ""), "y1": tongue(latin[:600], " "), "y2": tongue(latin[300:], " ")}
    m = language_id.Model({k: f(16_000)[:16_000] for k, f in tongues.items()})
    for k, f in tongues.items():
        got = m.predict([f(300) for _ in range(60)])
        assert sum(lang == k for lang, _ in got) >= 57, k


def test_samples_are_whole_rows(spark):
    rows = [(k, f"{'word ' * (k % 7 * 40)}end{k}", "en" if k % 2 else "de") for k in range(200)] + [(500, "z" * 50_000, "zz"), (501, None, "en"), (502, "...", "pp"), (503, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.learn(df, chars=3000)
    assert sorted(got) == ["de", "en", "zz"] and len(got["zz"]) == 50_000 and 3000 < len(got["en"]) < 4500
    assert {part.split().count("word") for part in got["en"].split("end")[:-1]} <= {40 * k for k in range(7)}


def test_held_out_accuracy(spark, sf):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in language_id.op5_language_id(spark, sf).collect()]
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_languages_of_odd_documents(odd, empty):
    got = language_id.predicted(odd, language_id.learn(odd))
    assert {(r["doc_id"], r["lang_pred"]) for r in got.collect() if r["doc_id"] in (1, 2, 3, 9)} == {(k, "und") for k in (1, 2, 3, 9)}
    assert got.count() == 12 and all(0 <= r["lang_score"] <= 1 for r in got.collect())
    assert {r["lang_pred"] for r in language_id.predicted(odd, {}).collect()} == {"und"}
    assert language_id.predicted(empty, language_id.learn(empty)).count() == 0


# -- fingerprints


def test_edit_report_by_brute_force(spark, sf, odd, empty):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        docs = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        want = []
        for k, (i, t) in enumerate(docs):
            n, q = docs[(k + 1) % len(docs)][1], len(t) // 4
            new = t[: len(t) - q] + n[:q]
            a, b = spotsigs.signatures(t), spotsigs.signatures(new)
            want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), spotsigs.to_hex(a), spotsigs.to_hex(b), spotsigs.jaccard(a, b), spotsigs.jaccard(a, spotsigs.signatures(n))))
        assert sorted(map(tuple, spotsigs.edit_report(df).collect()), key=str) == sorted(want, key=str)
    assert spotsigs.edit_report(empty).count() == 0


def test_fingerprints_tell_copies(spark, sf):
    got = spotsigs.op9_spotsigs(spark, sf).collect()
    assert sum(r["near_edited"] for r in got) / len(got) > 0.5 and sum(r["near_next"] for r in got) / len(got) < 0.05


@pytest.mark.parametrize("hot", [spotsigs.HOT, 2])
def test_near_classes_by_brute_force(spark, sf, odd, empty, hot):
    base = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    chain = ["the " + " the ".join(f"a{k} b{k}" for k in range(i, i + 30)) for i in range(12)]
    more = spark.createDataFrame([*[(None, t) for t in chain[:6]], *[(7, t) for t in chain[6:]], (7, chain[6]), (8, None), (9, "")], "doc_id long, text string")
    for df, floor in ((base, 0.5), (base.unionByName(more), 0.8), (odd, 0.8)):
        docs = [(r["doc_id"], r["text"]) for r in df.collect()]
        prints = [frozenset(brute_spots(t)) for _, t in docs]
        ids = {}
        for (i, _), s in zip(docs, prints, strict=True):
            ids.setdefault(s, []).append(i)
        classes = list(ids)
        links = {x: sum(bool(x and y and x is not y and len(x & y) >= floor * len(x | y)) for y in classes) for x in classes}
        want = sorted(((i, min((k for k in ids[s] if k is not None), default=None), links[s]) for (i, _), s in zip(docs, prints, strict=True)), key=str)
        assert sorted(map(tuple, spotsigs.near_classes(df, floor, hot=hot).collect()), key=str) == want
    assert spotsigs.near_classes(empty).count() == 0


def test_near_pairs_leave_lone_signatures_where_they_are(spark, monkeypatch):
    sets = [range(100 * k, 100 * k + 40) for k in range(20)] + [[*range(9000, 9030), *range(9100 + 10 * k, 9100 + 10 * k + k)] for k in range(10)]
    prints = spark.createDataFrame([(k, spotsigs.to_hex(set(x))) for k, x in enumerate(sets)], "name long, fingerprint string")
    kept, written = {}, spotsigs.written

    def counted(df, name):
        out = written(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(spotsigs, "written", counted)
    for floor in (0.5, 0.8, 1.0):
        want = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if len(set(x) & set(y)) >= floor * len(set(x) | set(y))}
        got = spotsigs.near_pairs(prints, floor).collect()
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
        assert kept["spots-prefix"] <= 10 * 31  # none of the 20 sets that share nothing


def brute_spots(text):
    """A text's chains with the number of each that came before, written anew."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in (re.sub(r"^\W+|\W+$", "", x) for x in re.split(r"[\x20\x09-\x0D]+", low)) if w]
    out, seen, chains, after, between = set(), collections.Counter(), [], [], None
    starts = []
    for w in words:  # whether each word begins a chain
        common = w in spotsigs.ANCHORS
        starts.append(common or between is None or between >= spotsigs.GAP)
        between = 0 if common else None if between is None else between + 1
    for w, begins in zip(reversed(words), reversed(starts), strict=True):  # after: the content words that follow
        if begins and len(after) >= 2:
            chains.append((w, *after[:2]))
        if w not in spotsigs.ANCHORS:
            after = [w, *after[:1]]
    for c in chains or ([tuple(words)] if words else []):
        out.add((c, seen[c]))
        seen[c] += 1
    return out


def test_jaccard():
    assert spotsigs.jaccard(set(), set()) == 1 and spotsigs.jaccard({1}, set()) == 0 and spotsigs.jaccard({1, 2}, {2, 3}) == 1 / 3 and spotsigs.jaccard({1}, {1, 2, 3}, 0.5) == 0


# -- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0 if d else False
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_by_brute_force(spark):
    r = random.Random(3)
    parts = ["a", "B.", "@", "@", ".", "-", " ", "1", "2", "25", "192.168.", "10.0.0.1", "+", "+4", "4111 1111 1111 1111", "4111111111111111", "(", "é", "🦆", "%", "_", ".com", "\n", "378 282", "00"]
    texts = [None, "", *["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)], "1" * 30000, "a." * 20000 + "@", "1." * 20000, "+1" * 5000, "x@y.zz " * 500]
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, base string")
    for row in pii.find(df).collect():
        want = base_spans(texts[row["doc_id"]])
        assert [(x["kind"], x["start"], x["stop"]) for x in row["base"]] == want
        assert not any(x["start"] < b and a < x["stop"] for x in row["added"] for _, a, b in want)


def test_added_spans(spark):
    filler = "and the words of it " * 3
    texts = [f"{filler} call me at (743) 201-{k:04d} or +44 20 7946 0{k:03d} today" for k in range(60)] + [f"{filler} version 100 200 {k:03d} of the table" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["added"] for r in pii.find(df).collect()}
    assert all(len(got[k]) == 1 and texts[k][got[k][0]["start"] : got[k][0]["stop"]].startswith("(743)") for k in range(60))
    assert not any(got[k] for k in range(60, 120))


def test_em_finds_the_reliable_labeler():
    counts = [((1, 1, 0, 1, 0), 80.0), ((1, 0, 0, 1, 1), 40.0), ((-1, -1, 0, 1, 0), 70.0), ((-1, 0, 0, -1, 0), 60.0)]
    share, reliable, chance = pii.expectation_maximisation(counts)
    assert chance[0] > 0.9 and chance[3] < 0.1 and reliable[0][1][1] > reliable[0][1][0] and 0 < share < 1


def test_many_spans_take_time_in_proportion(spark):
    """Also: offsets and overlaps agree with a plain search when there are thousands of them."""
    text = " ".join(f"a{k}@mail.example.com or tel (743) 201-{k % 10000:04d} +44 20 7946 {k % 10000:04d}" for k in range(12_000))
    began = time.monotonic()
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.monotonic() - began < 40  # comparing all spans with all takes minutes
    assert [(x["kind"], x["start"], x["stop"]) for x in row["base"]] == base_spans(text)
    assert [(x["start"], x["stop"]) for x in row["added"]] == [(m.start(), m.end()) for m in re.finditer(r"\(743\) 201-[0-9]{4}", text)]


def brute_loose(text):
    """Loose spans that overlap no base span, nor a loose one that starts earlier (then longer, then by kind)."""
    base = base_spans(text)
    found = sorted((m.start(), -m.end(), kind) for kind, p in (("phone", r"(?<![0-9A-Za-z+.,:/#_-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])(?![.,:/_-][0-9])"), ("ssn", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")) for m in re.finditer(p, text))
    free = [(a, -b, kind) for a, b, kind in found if not any(c < -b and a < d for _, c, d in base)]
    return [x for i, x in enumerate(free) if not any(y[1] > x[0] for y in free[:i])]


def test_loose_spans_by_brute_force(spark):
    r = random.Random(8)
    parts = ["212-555-0199", "(743) 201-5555", "078-05-1120", "123-45-6788", "+1 212 555 0199", "10.0.0.1", " ", " ", ", ", "x@y.zz", "4111 1111 1111 1111", " or ", "555 201 3333"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 200))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.candidates(df).collect():
        got = [(x["start"], x["stop"], x["kind"]) for x in row["loose"] if x["kind"] in ("phone", "ssn")]
        assert got == brute_loose(texts[row["doc_id"]])


def test_secrets_and_ibans(spark):
    filler = "and the words of it " * 3
    texts = [f'{filler} token = "{k:02x}bc3ff2ca8fb1e4c565a0eb63815530a948bdde" for x{k}@mail.example.com' for k in range(40)]
    texts += [f"{filler} IBAN DE89 3704 0044 0532 0130 00 of the account" for _ in range(20)] + [f"{filler} part AB12 3456 7890 1234 5678 of the order" for _ in range(20)]
    got = {r["doc_id"]: [x["kind"] for x in r["added"]] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[k] == ["secret"] for k in range(40)) and all(got[k] == ["iban"] for k in range(40, 60)) and not any(got[k] for k in range(60, 80))


def test_pii_of_odd_documents(spark, odd, empty):
    got = sorted(((r["doc_id"], r["text"] or "", [tuple(x) for x in r["base"]], [tuple(x) for x in r["added"]]) for r in pii.find(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect()), key=str)
    assert len(got) == 11 and all(base == base_spans(text) and not added for _, text, base, added in got)
    mixed = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (None, "a@b.co"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(((r["doc_id"], len(r["base"])) for r in pii.find(mixed).collect()), key=str) == [(1, 1), (1, 1), (2, 0), (3, 0), (None, 1)]
    assert pii.find(odd).count() == 12 and pii.find(empty).count() == 0
