"""Scoring of whole documents by a gated recurrent language model.

1. Blocks.  One pass over the documents cuts them into blocks of about BLOCK
   words; a block is written once, as its documents' word numbers (compressed),
   and its distinct words and their counts in training documents, dealt to places
   by a hash of the word.
2. Counts.  A place holds all that blocks have of its words (a block gives a word
   once, so a very common word comes as often as there are blocks); it sums them,
   and each block gets its own words' counts back.  Blocks' words travel as one
   value for a block and place, not as rows.  Every training document counts;
   nothing is sampled.
3. Model.  A gated recurrent unit reads the tokens; the output is factored by
   classes: P(word) = P(class | state) P(word | class, state).  The HEAD most
   frequent words lie in classes of equal frequency, with a softmax within the class
   that depends on the state; every other word lies in a class named by how it
   is spelt (its ending), within which it has its add-one share of the corpus
   counts.  A word that training never met is its class's one unknown word, of
   count zero, as in the base score.  So the distribution sums to 1.
   Weights are fitted by truncated backpropagation in numpy on all tokens of
   training documents: each block trains its own copy of common first weights,
   and the copies' weights are averaged by their tokens.  The first weights come
   from a bounded sample (beginnings of documents in the order of a hash of
   their ids, until FIT_TOKENS tokens; FIT_ROWS rows and FIT_CHARS characters a
   row at most).  Classes, shares and counts come from the whole corpus.
4. Scoring.  Lanes of documents advance together, in windows of STEPS tokens;
   the state is carried across windows to the end of a document and cleared
   there, so the score is the log-likelihood of the complete document.

Tokens: A-Z lower-cased words, then one end token.  Training documents are those
whose crc32(doc_id as text) mod 7 is not 2.

Defined results: null and empty texts are one end token; repeated rows are scored
each; without training tokens the counts are 0 and the model is uniform over its
classes; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_of_id, one_thread, only, parts, table, words_of, written

BLOCK = 1_500_000
HEAD = 384
HEAD_CLASSES = 16
ENDINGS = 40
HIDDEN = 24
STEPS = 24
LANES = 512
FIT_ROWS = 512
FIT_TOKENS = 240_000
FIT_CHARS = 8_192
FIT_LANES = 64
BLOCK_LANES = 256
FIT_STEPS = 16
FIT_PASSES = 2
RATE = 0.004
END = "\n"  # no word holds white space


def is_held_out(doc_id) -> bool:
    return crc_of_id(doc_id) % 7 == 2


MARKS = ".,;:!?\"')]}%$*#&|"


def _spelt(tail: str) -> str:
    return "0" if tail[-1:].isdigit() else tail or "."


def ending(word: str) -> str:
    """How a word is spelt, in short: its last two letters, or what stands in their place."""
    return _spelt(word.rstrip(MARKS)[-2:])


def endings(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """The same of many words: each one's place in a list of endings (which may name one twice), and the list."""
    tails = pc.utf8_slice_codeunits(pc.utf8_rtrim(words, characters=MARKS), -2, None).dictionary_encode()
    return np.asarray(tails.indices), [_spelt(t) for t in tails.dictionary.to_pylist()]


# -- blocks ---------------------------------------------------------------------

BLOCKS = "block long, doc_ids array<long>, lengths array<int>, codes binary, places binary, shards array<struct<words: binary, train: binary>>"
SLICE = 4 << 20  # bytes of text cut into words at once
END_BYTES = b" "  # the end token among a block's words, each of which a line end follows


def word_lists(texts: pa.Array):
    """Lower-cased (A-Z) words of some texts after another: (words of all, number of words of each)."""
    texts = texts.fill_null("")
    sizes, a = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SLICE, side="right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts[a:b]))
        words, counts = lists.flatten(), np.asarray(pc.list_value_length(lists), np.int64)
        held = np.asarray(pc.binary_length(words)) > 0  # white space at either end leaves an empty piece
        if not held.all():
            counts = np.diff(np.concatenate([[0], np.cumsum(held)])[np.concatenate([[0], np.cumsum(counts)])])
            words = words.filter(pa.array(held))
        yield words.cast(pa.string()), counts
        a = b


def blocks(docs: DataFrame, size: int = BLOCK, places: int | None = None) -> DataFrame:
    places = min(places or parts(docs.sparkSession), 1 << 16)

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        words, counts, ids, total = [], [], [], 0

        def flush():
            nonlocal seq, words, counts, ids, total
            coded = pa.chunked_array(words, pa.string()).dictionary_encode()  # one dictionary for all chunks
            names = [END_BYTES, *(coded.chunk(coded.num_chunks - 1).dictionary.cast(pa.binary()).to_pylist() if coded.num_chunks else [])]
            lengths = np.concatenate(counts)
            flat = np.zeros(total, np.int32)
            flat[np.arange(total - len(ids)) + np.repeat(np.arange(len(ids)), lengths)] = np.concatenate([np.asarray(c.indices) for c in coded.chunks] or [np.zeros(0, np.int32)]) + 1
            lengths += 1
            keep = np.repeat(np.array([not is_held_out(i) for i in ids]), lengths)
            train = np.bincount(flat[keep], minlength=len(names))
            place = (np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % places).astype("<u2")
            order = np.argsort(place, kind="stable")
            bounds, train, names = np.searchsorted(place[order], np.arange(places + 1)).tolist(), train[order], [names[k] for k in order.tolist()]
            shards = [{"words": b"\n".join([*names[i:j], b""]), "train": train[i:j].astype("<i4").tobytes()} if i < j else None for i, j in zip(bounds, bounds[1:], strict=False)]
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + seq], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int32())),
                    pa.array([packed(flat)], pa.binary()),
                    pa.array([place.tobytes()], pa.binary()),
                    pa.array([shards], pa.list_(pa.struct([("words", pa.binary()), ("train", pa.binary())]))),
                ],
                names=["block", "doc_ids", "lengths", "codes", "places", "shards"],
            )
            seq += 1
            words, counts, ids, total = [], [], [], 0
            return row

        for batch in batches:
            names, a = batch.column(0).to_pylist(), 0
            for found, lengths in word_lists(batch.column(1)):
                ends, i = np.concatenate([[0], np.cumsum(lengths)]), 0
                while i < len(lengths):
                    # up to the document with which the block is full
                    j = min(len(lengths), i + 1 + int(np.searchsorted(np.cumsum(lengths[i:] + 1), size - total)))
                    words.append(found[int(ends[i]) : int(ends[j])])
                    counts.append(lengths[i:j])
                    ids += names[a + i : a + j]
                    total += int(ends[j] - ends[i]) + j - i
                    i = j
                    if total >= size:
                        yield flush()
                a += len(lengths)
        if ids:
            yield flush()

    slim = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return slim.mapInArrow(run, BLOCKS)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers of four bytes compressed byte by byte: all lowest bytes come first."""
    return pa.compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked(numbers: bytes) -> np.ndarray:
    raw = np.frombuffer(pa.CompressedInputStream(pa.BufferReader(numbers), "zstd").read(), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").reshape(-1)


# There are as many pairs of block and place as words at most, but those may hold few words each where blocks and places
# are many, so what a task has of them is worked out at once.

COUNTS = "words array<string>, c array<long>, blocks array<long>, places array<int>, sizes array<int>, codes binary"


def counted(held: DataFrame, n: int) -> DataFrame:
    """All different words and their counts in training documents, some places' in a row; codes: the words' numbers there, `sizes` of them for each block and place."""

    def run(batches):
        owners, places, sizes, words, train = [], [], [], [], []
        for batch in batches:
            owners.append(batch.column(0))
            places.append(batch.column(1))
            sizes.append(np.asarray(pc.binary_length(batch.column(3))) // 4)
            words.append(pc.split_pattern(pa.array([b"".join(batch.column(2).to_pylist())]), "\n").values[:-1])
            train.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i4"))
        if not owners:
            return
        coded = pa.chunked_array(words, pa.binary()).dictionary_encode()  # one dictionary for all chunks
        names = coded.chunk(coded.num_chunks - 1).dictionary.cast(pa.string())
        names = pc.if_else(pc.equal(names, END_BYTES.decode()), END, names)
        codes, c = np.concatenate([np.asarray(x.indices) for x in coded.chunks]), np.zeros(len(names), np.int64)
        np.add.at(c, codes, np.concatenate(train))
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (names, pa.array(c), pa.concat_arrays(owners), pa.concat_arrays(places), pa.array(np.concatenate(sizes), pa.int32()))),
                pa.array([packed(codes)], pa.binary()),
            ],
            names=["words", "c", "blocks", "places", "sizes", "codes"],
        )

    shards = held.select("block", F.posexplode("shards").alias("place", "x")).where("x is not null")
    return shards.select("block", "place", "x.words", "x.train").repartition(n, "place").mapInArrow(run, COUNTS)


def values_of(numbers: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive numbers as binary values, so many in each."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * numbers.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(numbers)])


def in_order(places: bytes, shards: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and input numbers of a block's words in the order of their numbers."""
    order = np.argsort(np.frombuffer(places, "<u2"), kind="stable")
    turn = pa.array(np.argsort(np.asarray(shards.field("place"))))
    # each place's counts have the width that its own task needs
    widths = pc.divide(pc.multiply(pc.binary_length(shards.field("c")), 2), pc.binary_length(shards.field("inputs"))).take(turn).to_pylist()
    counts = shards.field("c").take(turn).to_pylist()
    if len(set(widths)) == 1:
        counts, widths = [b"".join(counts)], widths[:1]
    c, inputs = np.empty((2, len(order)), np.int64)
    c[order] = np.concatenate([np.frombuffer(x, f"<i{w}") for x, w in zip(counts, widths, strict=True)])
    inputs[order] = np.frombuffer(b"".join(shards.field("inputs").take(turn).to_pylist()), "<u2")
    return c, inputs


# -- model ----------------------------------------------------------------------

#: Of both gates and of the candidate: logistic(x) = 1 / (1 + exp(-x)), tanh(x) = 2 / (1 + exp(-2 x)) - 1; exact factors.
POWERS = np.float32([-1.0, -1.0, -2.0])


def logistic(power: np.ndarray, top: float = 1.0) -> None:
    """top / (1 + exp(power)), in place: numpy's exp takes half the time of its tanh."""
    np.exp(power, out=power)  # beyond its range infinite, and the result 0
    power += 1.0
    np.divide(top, power, out=power)


class Vocabulary:
    """Classes of words, from the corpus counts."""

    def __init__(self, head: list[tuple[str, int]], tails: list[tuple[str, int]]):
        """head: the most frequent words with counts; tails: (ending, sum of count + 1) of all other training words."""
        self.head = {w: k for k, (w, _) in enumerate(head)}
        mass = np.cumsum([n for _, n in head]) if head else np.zeros(0)
        self.head_class = (np.minimum(HEAD_CLASSES - 1, (mass - 1) * HEAD_CLASSES // max(1, mass[-1] if len(mass) else 1))).astype(np.int64)
        used = sorted(set(self.head_class.tolist()))
        self.head_class = np.searchsorted(used, self.head_class)
        self.members = [np.flatnonzero(self.head_class == c) for c in range(len(used))]
        self.place = np.zeros(len(head), np.int64)
        for m in self.members:
            self.place[m] = np.arange(len(m))
        self.heads = len(self.members)
        tails = sorted(tails, key=lambda t: (t[0] == "", -t[1], t[0]))
        self.tail_class = {t: self.heads + k for k, (t, _) in enumerate(tails[:ENDINGS]) if t}
        self.rest = self.heads + len(self.tail_class)
        self.classes = self.rest + 1
        # add-one mass of each tail class, with one unknown word
        self.mass = np.ones(self.classes)
        for k, (_, n) in enumerate(tails):
            self.mass[min(self.heads + k, self.rest)] += n
        self.inputs = len(head) + self.classes

    def of(self, words: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(input number, class) of each word; head words' inputs are their numbers."""
        words = pa.array(words, pa.string()) if isinstance(words, list) else words
        inputs = np.asarray(pc.index_in(words, value_set=pa.array(list(self.head), pa.string())).fill_null(-1)).astype(np.int64)
        codes, names = endings(words)
        classes = np.array([self.tail_class.get(e, self.rest) for e in names], np.int64)[codes]
        known = inputs >= 0
        classes[known] = self.head_class[inputs[known]]
        return np.where(known, inputs, len(self.head) + classes), classes


class Gru:
    """Weights; the input's share of the gates is one row an input."""

    def __init__(self, vocabulary: Vocabulary, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.v, self.h, self.rooms = vocabulary, hidden, {}
        f = np.float32
        self.p = {
            "X": (rng.standard_normal((vocabulary.inputs, 3 * hidden)) * 0.1).astype(f),
            "U": (rng.standard_normal((hidden, 3 * hidden)) / math.sqrt(hidden) * 0.7).astype(f),
            "C": np.zeros((hidden, vocabulary.classes), f),
            "c": np.zeros(vocabulary.classes, f),
            "W": np.zeros((len(vocabulary.head), hidden), f),
            "w": np.zeros(len(vocabulary.head), f),
        }

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rooms": {}}

    def _room(self, name: int, shape: tuple[int, ...], dtype) -> np.ndarray:
        """An array that is written anew in every window; its memory is kept."""
        held = self.rooms.get(name)
        if held is None or held.shape != shape or held.dtype != dtype:
            held = self.rooms[name] = np.empty(shape, dtype)
        return held

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        n = self.h
        g = h @ self.p["U"]
        a = x[:, : 2 * n] + g[:, : 2 * n]
        np.multiply(a, 0.5, out=a)
        np.tanh(a, out=a)
        a += 1.0
        a *= 0.5  # logistic
        r, z, gn = a[:, :n], a[:, n:], g[:, 2 * n :]
        r *= gn
        r += x[:, 2 * n :]
        cand = np.tanh(r, out=r)
        out = h - cand
        out *= z
        out += cand
        return out

    @staticmethod
    def bounded(weights: np.ndarray, biases: np.ndarray) -> bool:
        """Whether no state (numbers between -1 and 1) gives a logit whose exponential needs scaling."""
        return len(biases) > 0 and float((np.abs(weights).sum(axis=0) + np.abs(biases)).max()) < 60.0

    def class_logs(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.p["C"] + self.p["c"]
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def outputs(self) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """Weights, biases and whether they are bounded, of the classes and then of each class of head words."""
        each = [(self.p["C"], self.p["c"])] + [(self.p["W"][m].T, self.p["w"][m]) for m in self.v.members]
        return [(weights, biases, self.bounded(weights, biases)) for weights, biases in each]

    def log_probs(self, states: np.ndarray, inputs: np.ndarray, classes: np.ndarray, shares: np.ndarray, outputs: list | None = None) -> np.ndarray:
        """Natural log of each token's probability; shares: log share within the class of words outside the head."""
        (weights, biases, bounded), *heads = outputs or self.outputs()
        logits = states @ weights
        logits += biases
        if not bounded:
            logits -= logits.max(axis=1, keepdims=True)
        out = logits[np.arange(len(logits)), classes].astype(np.float64)
        np.exp(logits, out=logits)
        out -= np.log(logits @ np.ones(logits.shape[1], logits.dtype))
        tail = classes >= self.v.heads
        out[tail] += shares[tail]
        order = np.flatnonzero(~tail)
        order = order[np.argsort(classes[order], kind="stable")]
        bounds = np.searchsorted(classes[order], np.arange(self.v.heads + 1))
        for c, m in enumerate(self.v.members):
            rows = order[bounds[c] : bounds[c + 1]]
            if len(rows) and len(m) > 1:
                weights, biases, bounded = heads[c]
                inner = states[rows] @ weights
                inner += biases
                if not bounded:
                    inner -= inner.max(axis=1, keepdims=True)
                own = inner[np.arange(len(rows)), self.v.place[inputs[rows]]]
                np.exp(inner, out=inner)
                out[rows] += own - np.log(inner @ np.ones(len(m), inner.dtype))
        return out

    def fit(self, documents: list[np.ndarray], classes: np.ndarray, passes: int = FIT_PASSES, lanes: int = FIT_LANES, steps: int = FIT_STEPS, rate: float = RATE, seed: int = 11, fresh: bool = True) -> None:
        """Truncated backpropagation, Adam; documents: input numbers with the end token last; classes: of each input number; fresh: biases begin at the documents' shares."""
        documents = [d for d in documents if len(d)]
        if not documents:
            return
        rng = np.random.default_rng(seed)
        if fresh:
            tally = np.bincount(np.concatenate(documents), minlength=self.v.inputs) + 0.5
            per_class = np.bincount(classes, weights=tally, minlength=self.v.classes)
            self.p["c"][:] = np.log(per_class / per_class.sum())
            self.p["w"][:] = np.log(tally[: len(self.v.head)])
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        t = 0
        total = passes * (sum(map(len, documents)) // (lanes * steps) + 1)
        for _ in range(passes):
            flat = np.concatenate([documents[k] for k in rng.permutation(len(documents))])
            width = len(flat) // lanes
            use = min(lanes, len(flat)) if width == 0 else lanes
            width = max(1, len(flat) // use)
            grid = flat[: use * width].reshape(use, width)
            end = documents[0][-1]
            before = np.concatenate([np.full((use, 1), end), grid[:, :-1]], axis=1)
            h = np.zeros((use, self.h), np.float32)
            for a in range(0, width, steps):
                b = min(width, a + steps)
                h, grads = self._window(before[:, a:b], grid[:, a:b], classes, h, end)
                t += 1
                pace = rate * min(1.0, 2.0 * (1 - t / (total + 1)) + 0.05) * math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
                clip = min(1.0, 5.0 / (norm + 1e-9))
                for k, g in grads.items():
                    m, v = moments[k]
                    g *= clip
                    m *= 0.9
                    m += 0.1 * g
                    g *= g
                    g *= 0.001
                    v *= 0.999
                    v += g
                    np.sqrt(v, out=g)
                    g += 1e-8
                    np.divide(m, g, out=g)
                    g *= pace
                    self.p[k] -= g

    @np.errstate(over="ignore")
    def _window(self, before, target, classes, h, end):
        """States after a window of tokens, and the gradients of its loss (the states before it are taken as given)."""
        n, p = self.h, self.p
        lanes, steps = before.shape
        dtype, size, names, y = p["U"].dtype, lanes * steps, before.T.reshape(-1), target.T.reshape(-1)
        fresh = before.T == end
        keep, any_fresh = (~fresh)[:, :, None].astype(dtype), fresh.any(axis=1).tolist()
        starts, s, inner, to_cand, to_z, to_r = (self._room(k, (steps, lanes, n), dtype) for k in range(6))
        x, d, g = self._room(6, (3, steps, lanes, n), dtype), self._room(7, (4, steps, lanes, n), dtype), self._room(8, (3, lanes, n), dtype)
        r, z, cand = x
        # each gate's numbers lie together
        inputs, recurrent = self._by_gate()
        for k in range(3):
            np.take(inputs[k], names, axis=0, out=x[k].reshape(-1, n), mode="clip")
        for t in range(steps):
            if any_fresh[t]:
                h = h * keep[t]
            starts[t] = h
            np.matmul(h, recurrent[:2], out=g[:2])
            np.matmul(h, recurrent[2], out=inner[t])
            a = x[:2, t]
            a += g[:2]
            logistic(a)
            cand[t] += np.multiply(r[t], inner[t], out=g[2])
            logistic(cand[t], 2.0)
            cand[t] -= 1.0
            h = np.subtract(starts[t], cand[t], out=s[t])
            h *= z[t]
            h += cand[t]
        h = h.copy()  # the room is written anew
        flat = s.reshape(-1, n)
        cls = classes[y]
        scale = dtype.type(1.0 / lanes)
        grad = np.matmul(p["C"].T, flat.T, out=self._room(9, (self.v.classes, size), dtype))
        grad += p["c"][:, None]
        if not self.bounded(p["C"], p["c"]):
            grad -= grad.max(axis=0)
        np.exp(grad, out=grad)
        grad *= scale / grad.sum(axis=0)
        grad[cls, np.arange(size)] -= scale
        grads = {"C": flat.T @ grad.T, "c": grad.sum(axis=1), "W": np.zeros_like(p["W"]), "w": np.zeros_like(p["w"])}
        ds = grad.T @ p["C"].T
        order = np.flatnonzero(cls < self.v.heads)
        order = order[np.argsort(cls[order].astype(np.int16), kind="stable")]
        bounds, states, place = np.searchsorted(cls[order], np.arange(self.v.heads + 1)).tolist(), flat[order], self.v.place[y[order]]
        back, bounded = np.zeros_like(states), self.bounded(p["W"].T, p["w"])
        for c, m in enumerate(self.v.members):
            i, j = bounds[c], bounds[c + 1]
            if i < j and len(m) > 1:
                own, weights = states[i:j], p["W"][m]
                soft = weights @ own.T
                soft += p["w"][m][:, None]
                if not bounded:
                    soft -= soft.max(axis=0)
                np.exp(soft, out=soft)
                soft *= scale / soft.sum(axis=0)
                soft[place[i:j], np.arange(j - i)] -= scale
                grads["W"][m] = soft @ own
                grads["w"][m] = soft.sum(axis=1)
                np.matmul(soft.T, weights, out=back[i:j])
        ds[order] += back
        # what does not depend on later steps is worked out for all steps at once
        np.subtract(starts, cand, out=to_z)
        to_z *= z
        np.subtract(1, z, out=to_r)
        to_z *= to_r
        np.multiply(cand, cand, out=to_cand)
        np.subtract(1, to_cand, out=to_cand)
        to_cand *= to_r
        np.subtract(1, r, out=to_r)
        to_r *= r
        inner *= -0.5
        to_r *= inner
        ds = ds.reshape(steps, lanes, n)
        carry, back = None, np.ascontiguousarray(p["U"].reshape(n, 3, n).transpose(1, 2, 0))
        for t in range(steps - 1, -1, -1):
            dh = ds[t]
            if carry is not None:
                dh += carry
            # of both gates, of the state's share of the candidate, and of the candidate
            np.multiply(dh, to_cand[t], out=d[3, t])
            np.multiply(d[3, t], to_r[t], out=d[0, t])
            np.multiply(dh, to_z[t], out=d[1, t])
            np.multiply(d[3, t], r[t], out=d[2, t])
            dh *= z[t]
            np.matmul(d[:3, t], back, out=g)
            for k in range(3):
                dh += g[k]
            if any_fresh[t]:
                dh *= keep[t]
            carry = dh
        grads["U"] = np.matmul(starts.reshape(-1, n).T, d[:3].reshape(3, -1, n)).transpose(1, 0, 2).reshape(n, 3 * n)
        grads["X"] = self._by_input(names, [d[k].reshape(-1, n) for k in (0, 1, 3)])
        return h, grads

    def _by_gate(self) -> tuple[np.ndarray, np.ndarray]:
        """The inputs' rows and the recurrent weights, gate by gate; times what makes both gates and the candidate powers of a logistic's exponential."""
        x, u = ((weights.reshape(-1, 3, self.h) * POWERS[:, None].astype(weights.dtype)).transpose(1, 0, 2) for weights in (self.p["X"], self.p["U"]))
        return np.ascontiguousarray(x), np.ascontiguousarray(u)

    def _by_input(self, names: np.ndarray, dx: list[np.ndarray], by: int = 8) -> np.ndarray:
        """The tokens' gradients (gate by gate) summed by input: `by` rows of an input at a time, filled up with a row of zeros."""
        size, width = len(names), 3 * self.h
        rows = self._room(10, (size + 1, width), dx[0].dtype)
        for k, part in enumerate(dx):
            rows[:size, k * self.h : (k + 1) * self.h] = part
        rows[size] = 0
        counts = np.bincount(names)
        held = np.flatnonzero(counts)
        counts = counts[held]
        padded = -(-counts // by) * by
        ends = np.cumsum(padded)
        index = np.full(ends[-1], size)
        index[np.arange(size) + np.repeat(ends - padded - np.cumsum(counts) + counts, counts)] = np.argsort(names.astype(np.int16), kind="stable")
        index = np.ascontiguousarray(index.reshape(-1, by).T)
        total = rows.take(index[0], axis=0)
        for k in range(1, by):
            total += rows.take(index[k], axis=0)
        out, first = np.zeros_like(self.p["X"]), (ends - padded) // by
        out[held] = total[first]
        for k in np.flatnonzero(padded > by).tolist():
            total[first[k] : ends[k] // by].sum(axis=0, out=out[held[k]])
        return out

    @np.errstate(over="ignore")
    def score(self, words: np.ndarray, inputs: np.ndarray, classes: np.ndarray, shares: np.ndarray, lengths: np.ndarray, lanes: int = LANES, steps: int = STEPS) -> np.ndarray:
        """Natural log-likelihood of each document; words: of all documents, each with its end token last; inputs, classes, shares: of each word's number."""
        count = len(lengths)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        lanes = max(1, min(lanes, count))
        # longest documents first, each to the lane that is shortest so far
        order = np.argsort(-lengths, kind="stable")
        heap = [(0, k) for k in range(lanes)]
        lane_docs: list[list[int]] = [[] for _ in range(lanes)]
        for d in order.tolist():
            size, k = heapq.heappop(heap)
            lane_docs[k].append(d)
            heapq.heappush(heap, (size + int(lengths[d]), k))
        lane_docs.sort(key=lambda ds: -int(lengths[ds].sum()))
        sizes = np.array([int(lengths[ds].sum()) for ds in lane_docs])
        where = np.concatenate([np.arange(starts[d], starts[d] + lengths[d]) for ds in lane_docs for d in ds])
        owner = np.repeat(np.array([d for ds in lane_docs for d in ds], np.int32), [int(lengths[d]) for ds in lane_docs for d in ds])
        lane_at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        words = words[where]
        del where
        first = np.zeros(len(words), bool)
        first[lane_at] = True
        first[1:] |= owner[1:] != owner[:-1]
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[first] = words[lane_at[0] + lengths[lane_docs[0][0]] - 1]  # the end token
        # states and gates lie lane by lane, so that each gate's are together
        n, outputs, total = self.h, self.outputs(), np.zeros(count)
        x_all = self.p["X"] * np.repeat(POWERS, n)
        recurrent = np.ascontiguousarray((self.p["U"] * np.repeat(POWERS, n)).T)
        h = np.zeros((n, lanes), np.float32)
        a, longest = 0, int(sizes[0])
        while a < longest:
            m = int(np.searchsorted(-sizes, -a, side="left"))  # lanes longer than a
            wide = min(steps * max(1, min(16, lanes // m)), longest - a)  # the fewer lanes are left, the longer the window
            ends = np.minimum(sizes[:m], a + wide)
            at = (lane_at[:m] + a)[None, :] + np.arange(wide)[:, None]
            live = (a + np.arange(wide))[:, None] < ends[None, :]
            at = np.where(live, at, 0)
            xs = np.ascontiguousarray(x_all[inputs[before[at]]].transpose(0, 2, 1))
            keep = (~first[at]).astype(np.float32)
            fresh = (~keep.all(axis=1)).tolist()
            states = np.empty((wide, n, m), np.float32)
            g, gates = np.empty((3 * n, m), np.float32), np.empty((2 * n, m), np.float32)
            r, z = gates[:n], gates[n:]
            s = np.ascontiguousarray(h[:, :m])
            for t in range(wide):
                if fresh[t]:
                    s = s * keep[t]
                x, out = xs[t], states[t]
                np.matmul(recurrent, s, out=g)
                np.add(x[: 2 * n], g[: 2 * n], out=gates)
                logistic(gates)
                r *= g[2 * n :]
                r += x[2 * n :]
                logistic(r, 2.0)
                r -= 1.0
                np.subtract(s, r, out=out)
                out *= z
                out += r
                s = out
            h = s  # lanes that have ended are not looked at again
            at = at[live]
            word = words[at]
            got = self.log_probs(states.transpose(0, 2, 1)[live], inputs[word], classes[word], shares[word], outputs)
            total += np.bincount(owner[at], weights=got, minlength=count)
            a += wide
        return total


# -- the operator ---------------------------------------------------------------


def fit_sample(docs: DataFrame, rows: int = FIT_ROWS, tokens: int = FIT_TOKENS) -> list[list[str]]:
    """Words of training documents in the order of a hash of their ids, until the bound."""
    key = F.xxhash64(F.col("doc_id"), F.lit("fit"))
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    train = only(docs, "doc_id", "text").where((crc % 7) != 2)
    ids = [r["h"] for r in train.select(key.alias("h")).orderBy("h").limit(rows).collect()]
    if not ids:
        return []
    sized = train.withColumn("h", key).where((F.col("h") <= ids[-1]) & (F.length("text") > 0))
    out, total = [], 0
    for r in sized.select("h", F.substring("text", 1, FIT_CHARS).alias("text")).orderBy("h", "text").limit(rows).toLocalIterator():
        w = words_of(r["text"])
        out.append(w)
        total += len(w) + 1
        if total >= tokens:
            break
    return out


def fit_blocks(paired: DataFrame, model: Gru, classes: np.ndarray, rounds: int = 8) -> int:
    """Fits the model on every training token: one pass over each block from the model's weights, then their average; the tokens fitted."""
    shapes = {k: v.shape for k, v in model.p.items()}
    schema = "tokens long, weights binary"

    def summed(rows):
        tokens, total = 0, None
        for n, raw in rows:
            w = np.frombuffer(raw, np.float64)
            tokens, total = tokens + n, w if total is None else total + w
        return pa.RecordBatch.from_arrays([pa.array([tokens] if tokens else [], pa.int64()), pa.array([total.tobytes()] if tokens else [], pa.binary())], names=["tokens", "weights"])

    def one(ids, lengths, codes, places, shards):
        one_thread()
        inputs = in_order(places, shards)[1]
        cuts = np.cumsum(lengths)[:-1]
        documents = [d for i, d in zip(ids, np.split(inputs[unpacked(codes)], cuts), strict=True) if not is_held_out(i)]
        own = Gru(model.v, model.h)
        own.p = {k: v.copy() for k, v in model.p.items()}
        own.fit(documents, classes, passes=1, lanes=BLOCK_LANES, fresh=False)
        n = sum(map(len, documents))
        return n, (np.concatenate([v.reshape(-1) for v in own.p.values()]).astype(np.float64) * n).tobytes()

    def run(batches):
        yield summed(one(b.column(0)[k].as_py(), np.asarray(b.column(1)[k].values, np.int64), b.column(2)[k].as_py(), b.column(3)[k].as_py(), b.column(4)[k].values) for b in batches for k in range(b.num_rows))

    def again(batches):
        yield summed((b.column(0)[k].as_py(), b.column(1)[k].as_py()) for b in batches for k in range(b.num_rows))

    # summed in partitions, then in a few tasks, so that the driver receives a few models whatever the number of blocks
    rows = paired.select("doc_ids", "lengths", "codes", "places", "counts").mapInArrow(run, schema).repartition(rounds).mapInArrow(again, schema).collect()
    tokens = sum(r["tokens"] for r in rows)
    if tokens:
        flat = sum(np.frombuffer(r["weights"], np.float64) for r in rows) / tokens
        for (k, shape), part in zip(shapes.items(), np.split(flat, np.cumsum([math.prod(s) for s in shapes.values()])[:-1]), strict=True):
            model.p[k] = part.reshape(shape).astype(np.float32)
    return tokens


def score_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    spark = docs.sparkSession
    n = parts(spark)
    held = written(blocks(docs, block, n), "lm-blocks")
    summed = written(counted(held, n), "lm-counts")
    counts = summed.select(F.explode(F.arrays_zip("words", "c")).alias("x")).select(F.col("x.words").alias("word"), "x.c")
    facts = counts.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    total, distinct = int(facts["n"] or 0), int(facts["v"] or 0)
    known = counts.where("c > 0")
    head = [(r["word"], r["c"]) for r in known.orderBy(F.desc("c"), "word").limit(HEAD).collect()]
    if END not in {w for w, _ in head}:
        head = [*head[: HEAD - 1], (END, max(1, counts.where(F.col("word") == END).agg(F.sum("c")).first()[0] or 1))]
    # without training tokens the end token is no training word, but in the head
    vocabulary = Vocabulary(head, _tails(known, {w for w, _ in head}, total + distinct - sum(c + 1 for _, c in head) if total else 0))
    model = Gru(vocabulary)
    sample = fit_sample(docs)
    encoded = [vocabulary.of([*w, END])[0] for w in sample]
    classes = np.empty(vocabulary.inputs, np.int64)
    classes[: len(head)] = vocabulary.head_class
    classes[len(head) :] = np.arange(vocabulary.classes)
    model.fit(encoded, classes)

    own = with_inputs(summed, vocabulary).groupBy("block").agg(F.collect_list(F.struct("place", "c", "inputs")).alias("counts"))
    paired = held.select("block", "doc_ids", "lengths", "codes", "places").repartition(n, "block").join(own, "block")
    paired = written(paired, "lm-paired")
    fit_blocks(paired, model, classes)

    def run(batches):
        one_thread()
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(0)[k].as_py()
                lengths = np.asarray(batch.column(1)[k].values, np.int64)
                flat = unpacked(batch.column(2)[k].as_py())
                c, inputs = in_order(batch.column(3)[k].as_py(), batch.column(4)[k].values)
                cls = classes[inputs]
                shares = np.where(cls >= vocabulary.heads, np.log(c + 1.0) - np.log(vocabulary.mass[cls]), 0.0)
                base = np.log10((c + 1.0) / (total + 1.0 * (distinct + 1)))
                got = model.score(flat, inputs, cls, shares, lengths) / math.log(10)
                cuts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([is_held_out(i) for i in ids], pa.bool_()),
                        pa.array(lengths, pa.int64()),
                        pa.array(np.add.reduceat((c > 0)[flat].astype(np.int64), cuts), pa.int64()),
                        pa.array(np.full(len(ids), total), pa.int64()),
                        pa.array(np.add.reduceat(base[flat], cuts), pa.float64()),
                        pa.array(got, pa.float64()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    slim = paired.select("doc_ids", "lengths", "codes", "places", "counts")
    return slim.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def with_inputs(summed: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The counts and input numbers of each block's words, by block and place."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                words, c, owners, places, sizes = (batch.column(x)[k].values for x in range(5))
                inputs, c, sizes, codes = vocabulary.of(words)[0].astype("<u2"), np.asarray(c), np.asarray(sizes), unpacked(batch.column(5)[k].as_py())
                c = c.astype("<i4" if c.max() < 1 << 31 else "<i8")
                yield pa.RecordBatch.from_arrays([owners, places, values_of(c[codes], sizes), values_of(inputs[codes], sizes)], names=["block", "place", "c", "inputs"])

    return summed.mapInArrow(run, "block long, place int, c binary, inputs binary")


def _tails(known: DataFrame, head: set[str], whole: int) -> list[tuple[str, int]]:
    """(ending, sum of count + 1) of all training words outside the head, whole in all: the ENDINGS largest, and the rest as one."""
    common = pa.array(sorted(head), pa.string())

    def run(batches):
        for batch in batches:
            kept = pc.invert(pc.is_in(batch.column(0), value_set=common))
            codes, names = endings(batch.column(0).filter(kept))
            sums = np.zeros(len(names), np.int64)
            np.add.at(sums, codes, np.asarray(batch.column(1).filter(kept)) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums)], names=["ending", "n"])

    sums = known.select("word", "c").mapInArrow(run, "ending string, n long").groupBy("ending").agg(F.sum("n").alias("n"))
    top = [(r["ending"], r["n"]) for r in sums.orderBy(F.desc("n"), "ending").limit(ENDINGS).collect()]
    rest = whole - sum(n for _, n in top)
    # the rest comes last whatever its size, under a name that is no ending
    return [*top, ("", rest)] if rest else top


def op2_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
