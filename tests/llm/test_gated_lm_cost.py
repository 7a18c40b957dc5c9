"""What makes the language model's fit and scoring cheaper gives the same numbers."""

import collections
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabloom.llm import gated_lm
from tabloom.llm.shared import words_of

ODD = ["  A\tb\x0bC\x0c\r d  ", "", None, "   ", "\u00c9 \u00c0B\u2003x\x1cy \x85 z", "one", "\n", "\U0001d4b3Y\u00b2 9\u00b2 a. ?! \u0663 I\u0307 \u212a"]


def test_gates_by_exponentials():
    x = np.float32([-300.0, -90.0, -20.0, -1.0, -1e-3, 0.0, 1e-3, 1.0, 20.0, 90.0, 300.0])
    for top, scale, want in ((1.0, -1.0, 0.5 * np.tanh(x.astype(float) / 2) + 0.5), (2.0, -2.0, np.tanh(x.astype(float)) + 1.0)):
        got = x * np.float32(scale)
        with np.errstate(over="ignore"):
            gated_lm.logistic(got, top)
        assert np.abs(got - want).max() < 3e-7


def test_gradients_summed_by_input():
    rng = np.random.default_rng(6)
    m = gated_lm.Gru(gated_lm.Vocabulary([(f"w{k}", 9) for k in range(40)], [("x", 4)]), 5)
    for size in (1, 7, 8, 500):
        names = np.minimum(rng.geometric(0.2, size), m.v.inputs) - 1
        dx = [rng.standard_normal((size, 5)).astype(np.float32) for _ in range(3)]
        want = np.zeros((m.v.inputs, 15))
        np.add.at(want, names, np.concatenate(dx, axis=1))
        assert np.abs(m._by_input(names, dx) - want).max() < 1e-4


def test_tails_are_worked_out_once(spark):
    """All of the counts are read by Python once, not a second time for their sum."""
    rows = [(f"w{k}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}", k % 7 + 1) for k in range(3000)]
    head = {w for w, _ in rows[:20]}
    whole = sum(c + 1 for _, c in rows[20:])
    spark.sparkContext.setJobGroup("tails", "tails")
    try:
        got = gated_lm._tails(spark.createDataFrame(rows, "word string, c long"), head, whole)
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("tails") for s in tracker.getJobInfo(j).stageIds}
        ran = [i for i in map(tracker.getStageInfo, stages) if i and i.numCompletedTasks]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    sums = {}
    for w, c in rows[20:]:
        sums[gated_lm.ending(w)] = sums.get(gated_lm.ending(w), 0) + c + 1
    want = sorted(sums.items(), key=lambda t: (-t[1], t[0]))
    assert got == [*want[: gated_lm.ENDINGS], ("", sum(n for _, n in want[gated_lm.ENDINGS :]))]
    assert len(ran) <= 2


def test_words_of_many_texts(monkeypatch):
    for size in (1, 20, gated_lm.SLICE):
        monkeypatch.setattr(gated_lm, "SLICE", size)
        got = []
        for words, counts in gated_lm.word_lists(pa.array([*ODD, "x"], pa.string()).slice(1)):
            words = iter(words.to_pylist())
            got += [[next(words) for _ in range(n)] for n in counts.tolist()]
            assert next(words, None) is None
        assert got == [words_of(t) for t in [*ODD[1:], "x"]]


def test_endings_of_many_words():
    words = [*{w for t in ODD for w in words_of(t)}, "", "...", "ab1", "1)", "x\u00b2", "\U0001d4b3"]
    codes, names = gated_lm.endings(pa.array(words))
    assert [names[k] for k in codes.tolist()] == [gated_lm.ending(w) for w in words]


def test_numbers_packed():
    for x in ([], [0], [5, 0, 2**31 - 1]):
        assert gated_lm.unpacked(gated_lm.packed(np.array(x, np.int64))).tolist() == x


def test_words_of_blocks_travel_together(spark):
    """Of each block's words a place gets one row, and the block one row of it: rows moved do not grow with the words."""
    r = random.Random(5)
    texts = [*ODD, *(" ".join(f"w{int(r.paretovariate(0.3)) % 900}" for _ in range(r.randrange(200))) for _ in range(120))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).cache()
    held = gated_lm.blocks(docs, 1500, 5).cache()
    rows = {x["block"]: x for x in held.collect()}
    assert sum((x["doc_ids"] for x in rows.values()), []) == list(range(len(texts)))
    assert all(sum(x["lengths"]) >= 1500 > sum(x["lengths"][:-1]) for x in [*rows.values()][:-1]) and len(rows) > 5
    want = collections.Counter({w: 0 for t in texts for w in words_of(t)})
    for k, t in enumerate(texts):
        if not gated_lm.is_held_out(k):
            want.update([*words_of(t), gated_lm.END])
    summed = gated_lm.counted(held, 5).cache()
    whole = summed.collect()
    assert len(whole) <= 5
    assert sorted((w, c) for x in whole for w, c in zip(x["words"], x["c"], strict=True)) == sorted(want.items())
    v = gated_lm.Vocabulary(want.most_common(30), [("x", 4)])
    # counts of more than four bytes too, in some of the tasks
    far = summed.withColumn("c", F.expr("transform(c, (x, k) -> if(words[k] = 'w1', x + 5000000000, x))"))
    for counts, more in ((summed, 0), (far, 5_000_000_000)):
        shards = collections.defaultdict(list)
        for x in gated_lm.with_inputs(counts, v).collect():
            shards[x["block"]].append(x.asDict())
        assert sum(map(len, shards.values())) <= 5 * len(rows)
        for block, x in rows.items():
            c, inputs = gated_lm.in_order(x["places"], pa.array(shards[block]))
            flat, words = gated_lm.unpacked(x["codes"]), [w for k in x["doc_ids"] for w in [*words_of(texts[k]), gated_lm.END]]
            assert c[flat].tolist() == [want[w] + more * (w == "w1") for w in words]
            assert inputs[flat].tolist() == v.of(words)[0].tolist()
