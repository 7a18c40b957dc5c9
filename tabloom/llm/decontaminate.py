"""Benchmark decontamination by a BM25 index with block-max WAND.

A test item has a question (its first half, to the end of a sentence or line if one
is near) and an answer (the rest).  Both are cut into passages of at most ITEM_WORDS
words; an inverted index holds, for each word, its passages in order with the BM25
impact of each, in blocks that know their largest impact.  Impacts are divided by the
passage's own score against itself, so one threshold fits all passages.  Every document
is cut into overlapping windows such that any run of ITEM_WORDS words lies whole in one,
and each window is a query that retrieves all passages at or above the threshold:

* a block of passages in which the largest impacts of a stretch's words (of SPAN windows)
  do not add up to the threshold is skipped for all of its windows, then one in which
  those of a window's words do not, for that window;
* the others go through WAND: cursors in passage order, a pivot where the sum of
  largest impacts can reach the threshold, passages before it skipped.

An item of which any passage is retrieved is verified against the whole document: of its
question and of its answer, the share of word shingles that the document holds (which
are looked for only if the document has enough of the shingles' words).  The
document is contaminated if both shares are at least OVERLAP, however far apart they
stand, or that of the whole item is.  Question and answer are judged apart only if both
have a shingle's words; an item shorter than a shingle contaminates only a document that
has its words and no others.

Items are indexed ITEMS at a time; a worker builds the indexes once and keeps them, and
all of them are asked in one pass over the documents.  PASS_CHARS bounds the items' text
that travels to a worker at once: beyond it (some 16,000 items) there is another pass.
Document frequencies are those of all items.

Defined results: null or empty texts match nothing; an item without words matches
nothing; equal items, and items without an id, are each reported; a document row repeated
is reported once a row; very long texts are read whole, window by window; an empty table
of documents or of items gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, only, table

SHINGLE = 5
OVERLAP = 0.8
THRESHOLD = 0.6
ITEM_WORDS = 32
WINDOW = 64
STEP = WINDOW - ITEM_WORDS
K1, B = 1.2, 0.75
#: Items of an index; characters of items asked in one pass; passages of a block-max block.
ITEMS = 1_024
PASS_CHARS = 4_000_000
NARROW = 2
#: Windows of a stretch, which are looked up at once.
SPAN = 32

_WORD = re.compile(r"\w+")
_END = re.compile(r"[.!?\n]")
#: Of each Latin-1 character, its small letter if it is of a word, else a blank; no letter of Latin-1 has a small one elsewhere.
_LATIN = "".join(c if _WORD.match(c) else " " for c in map(str.lower, map(chr, range(256)))).encode("latin-1")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of word characters (\\w+)."""
    if not text:
        return []
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text.lower())


def shingles(w: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The item's words in two parts, cut at the sentence end nearest to its middle (else at the middle word)."""
    ends = [m.end() for m in _END.finditer(text) if words(text[: m.end()]) and words(text[m.end() :])]
    if ends:
        cut = min(ends, key=lambda e: (abs(e - len(text) / 2), e))
        return words(text[:cut]), words(text[cut:])
    w = words(text)
    return w[: (len(w) + 1) // 2], w[(len(w) + 1) // 2 :]


def passages(text: str | None) -> list[list[str]]:
    """The words of question and answer in equal pieces of at most ITEM_WORDS; of a short item, those of the whole."""
    if not text:
        return []
    parts = question_and_answer(text)
    if min(map(len, parts)) < SHINGLE:
        parts = (words(text),)
    out = []
    for w in parts:
        if w:
            size = -(-len(w) // -(-len(w) // ITEM_WORDS))
            out += [w[k : k + size] for k in range(0, len(w), size)]
    return out


class Statistics:
    """What BM25 needs of all items: passages, mean length, document frequencies of the index's words."""

    def __init__(self, n: int, mean: float, df: dict[str, int]):
        self.n, self.mean, self.df = n, mean, df

    def idf(self, word: str) -> float:
        d = self.df.get(word, 0)
        return math.log(1 + (self.n - d + 0.5) / (d + 0.5))


class Index:
    """Inverted index of some items' passages, in blocks of passages with each word's largest impact there.

    Passages that share their commonest word stand together, so a block's largest
    impacts belong to one language.  Postings are three arrays in order of (block, word, passage).
    """

    def __init__(self, items: list[tuple[int | None, str]], stats: Statistics):
        self.items = items
        cut = [(p, k) for k, (_, text) in enumerate(items) for p in passages(text)]
        cut.sort(key=lambda x: (max((stats.df.get(w, 0), w) for w in x[0]), len(x[0]), x[1]))
        self.owner = [k for _, k in cut]
        self.terms: dict[str, int] = {}
        at_, term_, impact_ = [], [], []
        for at, (p, _) in enumerate(cut):
            tf: dict[str, int] = {}
            for w in p:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(p) / stats.mean)
            impact = {w: stats.idf(w) * f * (K1 + 1) / (f + norm) for w, f in tf.items()}
            own = sum(impact.values())
            for w, x in impact.items():
                at_.append(at)
                term_.append(self.terms.setdefault(w, len(self.terms)))
                impact_.append(x / own)
        at, term, impact = np.array(at_, np.int64), np.array(term_, np.int64), np.array(impact_)
        self.blocks = -(-len(cut) // NARROW)
        keys = (at // NARROW) * len(self.terms) + term
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.impact = keys[order], at[order].astype(np.int32), impact[order]
        # each list's largest impact
        self.lists, self.begin = np.unique(self.keys, return_index=True)
        self.top = np.maximum.reduceat(self.impact, self.begin) if len(self.lists) else self.impact
        self.begin = np.append(self.begin, len(self.keys))
        self.tops = np.zeros((len(self.terms), self.blocks), np.float32)
        if len(self.lists):
            self.tops[self.lists % len(self.terms), self.lists // len(self.terms)] = self.top
        self._parts: list = [None] * len(items)

    def search(self, block: int, terms: np.ndarray, threshold: float) -> list[int]:
        """Passages of a block whose impacts of these distinct terms (in order) add up to the threshold: WAND."""
        wanted = block * len(self.terms) + terms
        where = np.searchsorted(self.lists, wanted)
        where = where[(where < len(self.lists)) & (self.lists[np.minimum(where, len(self.lists) - 1)] == wanted)]
        least, found = threshold - 1e-9, []
        cursors = []  # [passages, impacts, position, largest impact]
        for k in where.tolist():
            a, b = self.begin[k], self.begin[k + 1]
            cursors.append([self.at[a:b].tolist(), self.impact[a:b].tolist(), 0, float(self.top[k])])
        while cursors:
            cursors.sort(key=lambda c: c[0][c[2]])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[3]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            target = cursors[pivot][0][cursors[pivot][2]]
            if cursors[0][0][cursors[0][2]] == target:
                if sum(c[1][c[2]] for c in cursors if c[0][c[2]] == target) >= least:
                    found.append(target)
                target += 1
            for c in cursors:
                while c[2] < len(c[0]) and c[0][c[2]] < target:
                    c[2] += 1
            cursors = [c for c in cursors if c[2] < len(c[0])]
        return found

    def retrieve(self, w: list[str], threshold: float, worth=None) -> set[int]:
        """Items with a passage at or above the threshold in some window of the words; worth: of which items to ask."""
        out: set[int] = set()
        for a in range(0, len(w), SPAN * STEP):  # a stretch at a time, whatever the length of the text
            self._stretch(w[a : a + (SPAN + 1) * STEP], threshold, worth, out)
        return out

    def _stretch(self, w: list[str], threshold: float, worth, out: set[int]) -> None:
        """Adds what is retrieved by the SPAN windows that begin in a stretch: window k is the words of chunks k and k + 1."""
        known = self.terms.keys() & w
        if not known:
            return
        least = threshold - 1e-4
        bound = self.tops.take(np.fromiter(map(self.terms.__getitem__, known), np.int64, len(known)), axis=0).sum(axis=0)
        near = np.flatnonzero(bound >= least)
        if worth:
            asked = [any(map(worth, self.owner[b * NARROW : (b + 1) * NARROW])) for b in near.tolist()]
            near = near[np.array(asked, bool)]
        if not len(near):
            return
        none = len(self.terms)
        ids = np.fromiter(map(self.terms.get, w, repeat(none)), np.int64, len(w))
        at = np.flatnonzero(ids < none)
        pairs = at // STEP * none + ids[at]
        pairs = np.unique(np.concatenate([pairs, pairs - none]))  # each word of a window once
        window, term = np.divmod(pairs[(pairs >= 0) & (pairs < SPAN * none)], none)
        if not len(window):
            return
        first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        rows, blocks = np.nonzero(np.add.reduceat(self.tops[term[:, None], near], first, axis=0) >= least)
        ends = np.append(first[1:], len(term))
        for row, block in zip(rows.tolist(), near[blocks].tolist(), strict=True):
            found = [self.owner[p] for p in self.search(block, term[first[row] : ends[row]], threshold)]
            out.update(filter(worth, found) if worth else found)

    def parts_of(self, k: int) -> tuple[set, set, set]:
        if self._parts[k] is None:
            q, a = question_and_answer(self.items[k][1])
            self._parts[k] = (shingles(q), shingles(a), shingles(words(self.items[k][1])))
        return self._parts[k]

    def hits(self, w: list[str], threshold: float = THRESHOLD, overlap: float = 0.0) -> list[tuple[int, float, float, float]]:
        """(item, question share, answer share, whole share), for a document's words, of every retrieved item that the words alone let reach the overlap."""
        if not w or not self.terms:
            return []
        here: dict[int, set] = {}

        def share(part: set) -> float:
            for n in {len(s) for s in part}:
                if n not in here:
                    here[n] = shingles(w, n)
            return sum(s in here[len(s)] for s in part) / len(part) if part else 0.0

        return [(k, *map(share, self.parts_of(k))) for k in sorted(self.retrieve(w, threshold, self.worth(w, overlap)))]

    def worth(self, w: list[str], overlap: float):
        """Whether an item could have the overlap with a document: by its shingles whose words the document has, in whatever order."""
        have, known = set(w), {}

        def most(part: set) -> float:
            return sum(map(have.issuperset, part)) / len(part) if part else 0.0

        def of(k: int) -> bool:
            if k not in known:
                q, a, whole = self.parts_of(k)
                known[k] = most(whole) >= overlap or (most(q) >= overlap and most(a) >= overlap)
            return known[k]

        return of

    def contaminating(self, w: list[str], threshold: float, overlap: float) -> list[tuple[int, float, float]]:
        """(item, question share, answer share) of the items that contaminate a document of these words."""
        out = []
        for k, q, a, whole in self.hits(w, threshold, min(overlap, 1.0)):
            sizes = [len(next(iter(p), ())) for p in self.parts_of(k)]
            if sizes[2] < SHINGLE:
                hit = w == words(self.items[k][1])
            else:
                hit = whole >= overlap or (min(q, a) >= overlap and min(sizes[:2]) >= SHINGLE)
            if hit:
                out.append((k, q, a))
        return out


class Indexes:
    """Several indexes, asked one after another."""

    def __init__(self, items: list[tuple[int | None, str]], stats: Statistics, size: int):
        self.each = [Index(items[k : k + size], stats) for k in range(0, len(items), size)]

    def contaminating(self, text: str | None, threshold: float, overlap: float) -> list[tuple[int | None, float, float]]:
        """(item_id, question share, answer share) of every item that contaminates the text."""
        w = words(text)
        return [(index.items[k][0], q, a) for index in self.each for k, q, a in index.contaminating(w, threshold, overlap)]


def statistics_of(benchmark: DataFrame) -> DataFrame:
    """word, df over all items' passages; the row of the null word has the number and the words of passages."""

    def run(batches):
        for batch in batches:
            words_, lengths = [], []
            for t in batch.column(0).to_pylist():
                for p in passages(t):
                    words_ += [None, *set(p)]
                    lengths += [len(p), *[0] * len(set(p))]
            yield pa.RecordBatch.from_arrays([pa.array(words_, pa.string()), pa.array(lengths, pa.int64())], names=["word", "len"])

    return only(benchmark, "text").mapInArrow(run, "word string, len long").groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("len").alias("len"))


def passes(benchmark: DataFrame, chars: int = PASS_CHARS):
    """(items, statistics) of each pass: all items at once unless they have more than `chars` characters."""
    items = only(benchmark, "item_id", "text").where("text is not null")
    stats = statistics_of(items).cache()
    head = stats.where("word is null").first()
    if head is None:
        return
    n = max(1, -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // chars))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        rows = sorted(((r["item_id"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        if rows:
            own = sorted({w for _, t in rows for w in words(t)})
            frame = benchmark.sparkSession.createDataFrame([(w,) for w in own], "word string") if own else None
            df = {r["word"]: r["df"] for r in stats.join(frame, "word").collect()} if own else {}
            yield rows, Statistics(head["df"], head["len"] / head["df"], df)


def indexes(items: list[tuple[int | None, str]], stats: Statistics, name: str, size: int) -> Indexes:
    return kept(("indexes", name), lambda: Indexes(items, stats, size))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, size: int = ITEMS) -> DataFrame:
    """doc_id, item_id, question_overlap, answer_overlap of every contaminated document; no shuffle of documents."""
    schema = "doc_id long, item_id long, question_overlap double, answer_overlap double"
    slim = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = None
    for items, stats in passes(benchmark):
        def run(batches, items=items, stats=stats, name=uuid.uuid4().hex):
            index = indexes(items, stats, name, size)
            for batch in batches:
                rows = [(doc_id, *x) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in index.contaminating(text, threshold, overlap)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "question_overlap", "answer_overlap"]
                )

        found = slim.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, size: int = ITEMS) -> DataFrame:
    """The documents that no item contaminates, all columns as they were; no shuffle of documents."""
    at = docs.columns.index("text")
    for items, stats in passes(benchmark):
        def run(batches, items=items, stats=stats, name=uuid.uuid4().hex):
            index = indexes(items, stats, name, size)
            for batch in batches:
                yield batch.filter(pa.array([not index.contaminating(t, threshold, overlap) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
