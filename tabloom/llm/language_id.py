"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text.  A document is parsed greedily into the longest phrases that occur in that
sample: from each position the automaton is followed as far as it goes.  The
number of phrases, times log2 of the sample's length, is an estimate of the
cross entropy; the language with the smallest wins.  Automata are transition
tables, and the parses of many texts and all languages advance together in numpy.

Learning: whole labelled rows that may be learnt from: one for each language and each
of SAMPLE_ROWS hash classes, of middling length if there is one, until a language has
SAMPLE_CHARS characters: the documented bound of the fit.  Every letter of the sample
is learnt, whatever the number of scripts.  Prediction reads every text whole, as one
parse: long texts advance in windows, whose states are carried over.

Normalisation: lower case; letters stay, every run of anything else is one blank.

Defined results: null text, or a text without any letter, is "und" with score 0;
so is every text when there is no labelled row to learn from.  Ties go to the
alphabetically first language.  score = 1 - (best entropy / second best), 1 if one
language alone was learnt.  Rows are independent, so repeated rows get the same; an empty table
gives no rows; further columns are kept, those named like the result's are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_column, given_back, in_pieces, kept, only, table

SAMPLE_ROWS = 64
SAMPLE_CHARS = 16_000
TYPICAL = 512
#: Characters parsed one after another before the next window; characters of a batch of texts: of no influence on results.
WINDOW = 8_192
BATCH_CHARS = 1 << 21
#: Letters with a column in the transition tables; the others' transitions are in a sorted list.
DENSE = 48
UNKNOWN = "und"


class Automaton:
    """Suffix automaton of a sequence of small integers."""

    def __init__(self, codes):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in codes:
            last = self._add(int(c), last)

    def _add(self, c: int, last: int) -> int:
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[q] == self.length[p] + 1:
                self.link[cur] = q
            else:
                twin = len(self.next)
                self.next.append(dict(self.next[q]))
                self.link.append(self.link[q])
                self.length.append(self.length[p] + 1)
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = twin
                    p = self.link[p]
                self.link[q] = self.link[cur] = twin
        return cur


_KINDS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _KINDS:
        _KINDS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _KINDS[0]


def points(text: str) -> np.ndarray:
    """Lower-cased code points with every run of non-letters as one 0; empty if there is no letter."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[raw]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of each run of others
    if len(keep):
        keep[0] = is_letter[0]
    out = np.where(is_letter, raw, 0)[keep]
    if len(out) and out[-1] == 0:
        out = out[:-1]
    return out


class Model:
    """Languages with their automata; built anew in each worker from the samples alone.

    Transitions by the DENSE commonest letters of all samples are a table; those by any
    other letter of a sample are looked up in one sorted list, so no letter is left out.
    """

    #: Above the bits of a state: how many phrases a step ends.
    SHIFT = 29

    def __init__(self, samples: dict[str, str]):
        self.samples = {k: samples[k] for k in sorted(samples)}
        self.languages = [k for k, v in self.samples.items() if v]
        texts = {k: np.array([ord(c) if c != " " else 0 for c in self.samples[k]], np.int64) for k in self.languages}
        tally: dict[int, int] = {}
        for t in texts.values():
            for c, n in zip(*np.unique(t, return_counts=True), strict=True):
                tally[int(c)] = tally.get(int(c), 0) + int(n)
        alphabet = sorted((c for c in tally if c), key=lambda c: (-tally[c], c))
        self.codes = np.ones(0x110000, np.int32)  # 0: blank, 1: a letter of no sample
        self.codes[0] = 0
        self.codes[alphabet] = np.arange(2, 2 + len(alphabet))
        self.letters = 2 + len(alphabet)
        self.width = min(self.letters, DENSE)
        tables, sizes = [], []
        keys: list[int] = []
        goes: list[int] = []
        states = 0
        for k in self.languages:
            auto = Automaton(self.codes[texts[k]])
            if len(auto.next) * self.width >> self.SHIFT:
                raise ValueError(f"the sample of {k} is too long")
            t = np.empty((len(auto.next), self.width), np.int32)
            t[:] = 2 << self.SHIFT  # a character that no phrase begins with ends the phrase and is one itself
            t[0] = 1 << self.SHIFT
            for c, q in auto.next[0].items():
                if 1 != c < self.width:
                    t[:, c] = q * self.width | 1 << self.SHIFT  # the phrase ends, the next begins
            for state, step in enumerate(auto.next):
                for c, q in step.items():
                    if c >= self.width:
                        keys.append((states + state) * self.letters + c)
                        goes.append(q * self.width)
                    elif c != 1:
                        t[state, c] = q * self.width
            tables.append(t.reshape(-1))
            sizes.append(len(auto.next))
            states += len(auto.next)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if sizes else np.zeros(0, np.int64)  # each language's first state
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        # a key that no text reaches stands last, so that every search ends on a key
        self.keys = np.concatenate([np.array(keys, np.int64)[order], [np.iinfo(np.int64).max]])
        self.goes = np.concatenate([np.array(goes, np.int32)[order], [0]]).astype(np.int32)
        self.scale = np.array([math.log2(max(2, len(texts[k]))) for k in self.languages])

    def _rare(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The table's entries of letters beyond it."""
        key = (state // self.width + self.first) * self.letters + code[:, None]
        at = np.searchsorted(self.keys, key)
        begin = self.first * self.letters + code[:, None]
        start = np.searchsorted(self.keys, begin)
        begins = np.where(self.keys[start] == begin, self.goes[start] | np.int32(1 << self.SHIFT), np.where(state == 0, np.int32(1 << self.SHIFT), np.int32(2 << self.SHIFT)))
        return np.where(self.keys[at] == key, self.goes[at], begins)

    def parse(self, windows: list[np.ndarray], states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each window in each language, and the states after it; states: those before it."""
        order = np.argsort([-len(w) for w in windows], kind="stable")
        sizes = np.array([len(windows[k]) for k in order], np.int64)
        flat = np.concatenate([windows[k] for k in order])
        dense = np.where(flat < self.width, flat, 1).astype(np.int64)
        rare = flat >= self.width
        mixed = bool(rare.any())
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        state = states[order]
        count = np.zeros(state.shape, np.int32)
        low, shift = np.int32((1 << self.SHIFT) - 1), np.int32(self.SHIFT)
        base = self.first * self.width
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
        for t, m in enumerate(active):
            at = starts[:m] + t
            s = state[:m]
            v = self.table.take(s + (base + dense[at][:, None]))
            if mixed and len(odd := np.flatnonzero(rare[at])):
                v[odd] = self._rare(s[odd], flat[at[odd]])
            count[:m] += v >> shift
            np.bitwise_and(v, low, out=s)
        counts, after = np.empty_like(count), np.empty_like(state)
        counts[order], after[order] = count, state
        return counts, after

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language.

        Long texts are cut into windows that are parsed side by side, at first as if a
        phrase began at each.  A window whose predecessor ends in another state than it
        began with is parsed again from that state, until all agree: the parse is that of the whole text.
        """
        windows, owner = [], []
        for k, c in enumerate(texts):
            for a in range(0, max(1, len(c)), WINDOW):
                windows.append(c[a : a + WINDOW])
                owner.append(k)
        owner = np.array(owner, np.int64)
        begun = np.zeros((len(windows), len(self.languages)), np.int32)
        counts, after = self.parse(windows, begun)
        follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        while len(follows):
            again = follows[(after[follows - 1] != begun[follows]).any(axis=1)]
            if not len(again):
                break
            begun[again] = after[again - 1]
            counts[again], after[again] = self.parse([windows[k] for k in again], begun[again])
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        np.add.at(total, owner, counts)
        last = np.flatnonzero(np.concatenate([owner[1:] != owner[:-1], [True]])) if len(owner) else owner
        total[owner[last]] += after[last] != 0  # the phrase that the text ends in
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        told = [(k, p) for k, t in enumerate(texts) if t and len(p := points(t))]
        if not told:
            return out
        entropy = self.phrases([self.codes[p] for _, p in told]) * self.scale
        for (k, _), e in zip(told, entropy, strict=True):
            best = int(np.argmin(e))
            rest = np.delete(e, best)
            out[k] = (self.languages[best], float(1 - e[best] / rest.min()) if len(rest) else 1.0)
        return out


def learn(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """language -> normalised sample text, of rows (doc_id, text, lang).

    Of each language and each of `rows` classes of a hash of the id, the row whose length is
    nearest to TYPICAL (in steps of 256 characters, then by the hash) is drawn; drawn rows are
    taken whole, in that order, until a language has `chars` characters.
    """
    told = only(labelled, "doc_id", "text", "lang").where("lang is not null and text rlike '[^\\\\s]'")
    key = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    size = F.length("text")
    away = F.floor(F.abs(size - F.lit(TYPICAL)) / 256)
    best = F.min(F.struct(away.alias("away"), key.alias("h"), "doc_id", size.alias("size"), F.xxhash64("text").alias("text_hash"))).alias("x")
    drawn = told.groupBy("lang", F.pmod(key, F.lit(rows)).alias("class")).agg(best).select("lang", "x.*").collect()  # at most `rows` a language
    taken: dict[str, int] = {}
    chosen = []
    for r in sorted(drawn, key=lambda r: (r["lang"], r["away"], r["h"])):
        if taken.get(r["lang"], 0) < chars:
            taken[r["lang"]] = taken.get(r["lang"], 0) + r["size"]
            chosen.append((r["lang"], r["h"], r["text_hash"]))
    if not chosen:
        return {}
    ids = labelled.sparkSession.createDataFrame(chosen, "lang string, h long, text_hash long")
    found = told.withColumns({"h": key, "text_hash": F.xxhash64("text")}).join(ids.hint("broadcast") if len(chosen) <= 100_000 else ids, ["lang", "h", "text_hash"], "left_semi")
    held: dict[tuple, str] = {}
    for r in found.select("lang", "h", "text_hash", "text").toLocalIterator():
        held[r["lang"], r["h"], r["text_hash"]] = "".join(chr(c) if c else " " for c in points(r["text"]))
    samples: dict[str, list[str]] = {}
    for k in chosen:
        if held.get(k):
            samples.setdefault(k[0], []).append(held[k])
    return {k: " ".join(v) for k, v in samples.items()}


def model(samples: dict[str, str]) -> Model:
    return kept(("languages", tuple(sorted(samples.items()))), lambda: Model(samples))


def predicted(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """All columns of docs, lang_pred and lang_score; one pass, no shuffle."""
    schema = docs.drop("lang_pred", "lang_score").schema.add("lang_pred", "string").add("lang_score", "double")
    kept = [n for n in docs.columns if n not in ("lang_pred", "lang_score")]
    at = kept.index("text")

    def run(batches):
        guess = model(samples)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            got = [x for some in in_pieces(texts, lambda t: len(t or ""), BATCH_CHARS) for x in guess.predict(some)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*kept, "lang_pred", "lang_score"]
            )
        given_back()

    return docs.select(*[F.col(f"`{n}`") for n in kept]).mapInArrow(run, schema)


def held_out() -> F.Column:
    return crc_column() % 5 == 0


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = learn(docs.where(~held_out()))
    return predicted(only(docs, "doc_id", "text"), samples).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
