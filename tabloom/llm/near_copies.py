"""Near copies by word shingles: SimHash and covering masks find candidates, the exact Jaccard index links.

A text is the set of its shingles of WORDS words (A-Z lower-cased, repeats once).
Two texts are linked if the Jaccard index of their sets is at least LIKENESS; a
group is what links connect.

1. Equal sets are one class first, so exact copies are read once.
2. A set's SimHash has PARTS words of 64 bits: a bit is 1 if set in over half of the
   shingles' hashes (at a tie it is the least hash's own).  Sets of likeness s differ
   in a share acos(2 s / (1 + s)) / pi of the bits, 0.15 at 0.8: too many for one word
   and RADIUS bits, which is why there are PARTS of them.  In each part the covering
   masks of simhash.masks find every pair within RADIUS of the part's first BITS bits,
   and by chance many that are further apart.  Of a bucket's pairs those are candidates
   that differ in at most NEAR of the part's and the next part's 128 bits, which keeps
   unlike texts apart.  All this loses a pair only by the fingerprints' own chance.
   A part and a range of its masks' keys are one task, of about ROOM classes; of what
   all its masks connect it tells each class's smallest, so a group of any size gives
   a task's members one row each, not one for each mask or pair.
3. What candidates connect is searched for links by growing sets, with the sets
   themselves.  Only texts of candidates are moved, one of each class: a bitmap of their
   keys holds the others back where they are read.  More than HOT classes are dealt to
   blocks of about HOT / 2.  The first block is searched together with each other one;
   then those that are outside of the largest set of linked ones are searched together
   with all others, block by block.  No pair of different linked sets is left out and no
   task holds them all; the texts read grow with the product of the group and of those
   outside, so with the group's square only where most of it is not linked.

Defined results: a text of fewer words than a shingle is one shingle; null text
and texts without words are one group; repeated rows and rows without an id are judged
like any other (see simhash.one_of_each); very long texts are read whole; further columns
stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import byte_words, cut, drop_made, given_back, kept, made, only, written
from .simhash import SALTS, id_order, masks, rows_that_stay

WORDS = 5
LIKENESS = 0.8
PARTS = 40
BITS = 48
RADIUS = 4
NEAR = 32
#: Classes that a task searches for candidates; members from which a bucket is searched by growing sets.
ROOM = 2_000_000
FEW = 16
#: Classes that candidates connect, up to which one task searches them at once.
HOT = 512
#: Bits of the bitmap for each key that it lets through, and bits at most; tasks that make it.
SIFT = 32
MOST = 1 << 28
MAKERS = 8

_MASKS = np.array(masks(RADIUS, BITS), np.uint64)
_KEYS = np.random.default_rng(20).integers(0, 1 << 64, PARTS, np.uint64, endpoint=False)
_ONE, _TWO, _LOW = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x0101010101010101)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers whose every bit depends on all of x, which is overwritten."""
    x *= _ONE
    x ^= x >> np.uint64(32)
    x *= _TWO
    x ^= x >> np.uint64(29)
    return x


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingles' hashes, sorted, of a text in UTF-8."""
    got = byte_words(text)
    if not got:
        return np.zeros(0, np.uint64)
    n = max(1, len(got) - WORDS + 1)
    h, join = xxhash.xxh64_intdigest, b" ".join
    joined = map(join, zip(*(got[k : k + n] for k in range(WORDS)), strict=True)) if len(got) >= WORDS else [join(got)]
    return np.unique(np.fromiter(map(h, joined), np.uint64, n))


def simhash_parts(hashes: np.ndarray) -> np.ndarray:
    """PARTS words of a set's SimHash; none of an empty set."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    if n % 2 == 0:
        hashes, n = np.concatenate([hashes, hashes[:1]]), n + 1
    ones = np.zeros((8, PARTS, 8), np.int32)
    for a in range(0, n, 255):  # eight 8-bit counters side by side in a word, emptied before they can overflow
        some = mixed(hashes[a : a + 255, None] ^ _KEYS)
        for k in range(8):
            ones[k] += (some >> np.uint64(k) & _LOW).sum(axis=0).view(np.uint8).reshape(PARTS, 8)
    bits = (2 * ones > n).transpose(1, 2, 0)  # part, byte, bit of the byte
    return np.packbits(np.ascontiguousarray(bits), axis=2, bitorder="little").reshape(-1).view("<i8")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the text), set_hash (of its shingles, 0 without words) and prints (its SimHash) of every document; no shuffle."""

    def run(batches):
        kept("near-copies")
        for batch in batches:
            names, keys = np.zeros(batch.num_rows, np.uint64), []
            for k, text in enumerate(batch.column(1).cast(pa.binary())):  # one text's shingles at a time
                own = shingle_set(text.as_py())
                names[k] = xxhash.xxh64_intdigest(own.tobytes()) if len(own) else 0
                keys.append(simhash_parts(own))
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names.view(np.int64)), flat], names=["doc_id", "text_hash", "set_hash", "prints"])
        given_back()

    slim = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, set_hash long, prints array<long>")


def forest(sets: list[np.ndarray], likeness: float = LIKENESS) -> list[tuple[int, int]]:
    """Edges (numbers of sets) of a spanning forest of the links among non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), np.int32)
    rest = np.ones(len(sets), bool)
    edges: list[tuple[int, int]] = []
    for first in range(len(sets)):
        front = [first] if rest[first] else []
        rest[first] = False
        while front and rest.any():
            x = front.pop()
            own = flat[starts[x] : starts[x] + sizes[x]]
            mark[own] = 1
            both = np.add.reduceat(mark[flat], starts)
            mark[own] = 0
            near = np.flatnonzero(rest & (both / (sizes + sizes[x] - both) >= likeness)).tolist()
            rest[near] = False
            edges += [(x, y) for y in near]
            front += near
    return edges


def ranges_of(words: np.ndarray, mask: np.uint64, ranges: int) -> np.ndarray:
    """The range that each word's key under a mask is dealt to."""
    return mixed(words & mask ^ mask >> np.uint64(3)) % np.uint64(ranges)


def joined(root: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """root (of every number the smallest that it is connected with) after pairs of numbers are connected too."""
    a, b = root[pairs[:, 0]], root[pairs[:, 1]]
    while (apart := a != b).any():
        a, b = a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
        a, b = root[a], root[b]
    return root


def bucket_pairs(rows: np.ndarray, keys: np.ndarray, root: np.ndarray) -> list[np.ndarray]:
    """Pairs that connect all that share a key and differ in at most NEAR bits, but for large buckets that root connects already.

    rows: a number, a part and the next part.
    """
    order = np.argsort(keys)
    keys = keys[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(cuts)
    out = []
    small = (sizes > 1) & (sizes <= FEW)
    for size in np.unique(sizes[small]).tolist():
        own = rows[order[cuts[:-1][sizes == size][:, None] + np.arange(size)]]
        for gap in range(1, size):
            x, y = own[:, gap:], own[:, :-gap]
            near = np.bitwise_count(x[:, :, 1:] ^ y[:, :, 1:]).sum(axis=2) <= NEAR
            out.append(np.stack([x[near][:, 0], y[near][:, 0]], axis=1))
    for k in np.flatnonzero(sizes > FEW).tolist():
        rest = rows[order[cuts[k] : cuts[k + 1]]]
        if len(np.unique(root[rest[:, 0].astype(np.int64)])) == 1:
            continue
        while len(rest) > 1:
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                near = np.bitwise_count(rest[:, 1:] ^ x[1:]).sum(axis=1) <= NEAR
                got, rest = rest[near], rest[~near]
                out.append(np.stack([got[:, 0], np.full(len(got), x[0])], axis=1))
                front += list(got)
    return out


def candidates(classes: DataFrame, room: int = ROOM) -> DataFrame:
    """Edges (a, b) of set_hash that connect the pairs of classes (set_hash, prints) which the covering masks find.

    a is the smallest that a task connects with b, so where parts agree their edges are the same.
    """
    ranges = max(1, -(-classes.count() // room))

    def deal(batches):
        for batch in batches:
            batch = batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column(1)), 0))
            ids = batch.column(0).to_numpy().view(np.uint64)
            prints = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, PARTS)
            to: tuple[list, list, list] = ([], [], [])
            for part in range(PARTS if len(ids) else 0):
                rows = np.stack([ids, prints[:, part], prints[:, (part + 1) % PARTS]], axis=1)
                goes = np.stack([ranges_of(rows[:, 1], m, ranges) for m in _MASKS], axis=1) if ranges > 1 else None
                for r in range(ranges):
                    own = rows if goes is None else rows[(goes == r).any(axis=1)]
                    for column, x in zip(to, (part, r, own.tobytes()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(to, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "range", "rows"])

    def search(group: pa.Table) -> pa.Table:
        kept("near-copies")
        r = group.column("range")[0].as_py()
        rows = np.frombuffer(b"".join(group.column("rows").to_pylist()), np.uint64).reshape(-1, 3)
        rows = rows[np.argsort(rows[:, 0].view(np.int64))]  # in the order of ids, so the smallest number is that of the smallest id
        ids, root = rows[:, 0].astype(np.int64), np.arange(len(rows))
        rows[:, 0] = np.arange(len(rows))
        for m in _MASKS:
            own = rows if ranges == 1 else rows[ranges_of(rows[:, 1], m, ranges) == r]
            got = bucket_pairs(own, own[:, 1] & m, root)
            if got:
                root = joined(root, np.concatenate(got).astype(np.int64))
        hung = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": ids[root[hung]], "b": ids[hung]})

    dealt = classes.select("set_hash", "prints").mapInArrow(deal, "part int, range int, rows binary")
    return dealt.groupBy("part", "range").applyInArrow(search, "a long, b long").distinct()


def sifted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is among keys, and at most a few in SIFT others: nothing of rows is moved."""
    size = 32_768  # bits of a bitmap of Spark's
    bits = min(MOST, -(-max(1, keys.count()) * SIFT // size) * size)
    place = (F.pmod(F.xxhash64(*on), F.lit(bits)) + 1).alias("__place")
    bucket = F.bitmap_bucket_number("__place").alias("__bucket")
    held = keys.select(place).coalesce(MAKERS).groupBy(bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__place")).alias("__bits"))
    there = rows.select("*", place).select("*", bucket, F.bitmap_bit_position("__place").alias("__at"))
    byte = "cast(conv(hex(substring(__bits, cast(__at div 8 as int) + 1, 1)), 16, 10) as int)"
    return there.join(F.broadcast(held), "__bucket").where(f"shiftright({byte}, cast(__at % 8 as int)) & 1 = 1").select(*[F.col(f"`{c}`") for c in rows.columns])


def texts_of(member: DataFrame, docs: DataFrame) -> DataFrame:
    """member (node, root, m, and of one row of the class z, id and text_hash) with that row's text."""
    on = ["z", "id", "text_hash"]  # never null, so the join's partitions serve what follows
    own = only(docs, "doc_id", "text").select("text", F.col("doc_id").isNull().alias("z"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("text_hash"))
    return sifted(own, member, on).join(member, on).dropDuplicates(on).select("node", "root", "m", "text")


def by_root(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (node, root, ...) with their group's columns: a group may hold a third of all classes, so it is met in SALTS tasks."""
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["root", "salt"]).drop("salt")


def linked(dealt: DataFrame) -> DataFrame:
    """Edges (a, b) that connect every linked pair of nodes dealt to the same root, x and y; dealt: these, node and text."""

    def run(rows: pa.Table) -> pa.Table:
        nodes = rows.column("node").to_pylist()
        edges = forest([shingle_set(t) for t in rows.column("text").cast(pa.binary()).to_pylist()])
        return pa.table({c: pa.array([nodes[e[k]] for e in edges], pa.int64()) for k, c in enumerate("ab")})

    return dealt.select("root", "x", "y", "node", "text").groupBy("root", "x", "y").applyInArrow(run, "a long, b long")


def blocks_of(count: str, hot: int) -> F.Column:
    return F.ceil(F.col(count) / F.lit(max(1, hot // 2))).cast("int")


def first_round(text: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows of text (node, root, m, text) dealt to x and y: a group of at most hot is one, of others the first block goes to each other block."""
    blocks = text.withColumn("blocks", F.when(F.col("m") <= hot, F.lit(1)).otherwise(blocks_of("m", hot)))
    own = blocks.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    goes = F.when((F.col("blocks") > 1) & (F.col("own") == 0), F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("own"))
    return own.withColumn("y", F.explode(goes)).withColumn("x", F.lit(0))


def second_round(told: DataFrame, hot: int = HOT) -> DataFrame | None:
    """node, root, x and y of large groups: those outside of the largest linked set meet each other and all others; None if there are none outside.

    told: node, root and label, the linked set.
    """
    sets = told.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"))
    top = sets.groupBy("root").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("m")).where("m > top.n")
    top = cut(top.select("root", F.col("top.label").alias("most"), F.col("top.n").alias("inside"), (F.col("m") - F.col("top.n")).alias("outside")))
    if top.isEmpty():
        return None
    rows = by_root(told, top).select("node", "root", (F.col("label") != F.col("most")).alias("out"), blocks_of("outside", hot).alias("outer"), blocks_of("inside", hot).alias("inner"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    own = F.when(F.col("out"), place("outer")).otherwise(F.col("outer") + place("inner"))
    others = F.when(F.col("out"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1
    met = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), others))).where("own <> other")
    return met.select("node", "root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))


def links(classes: DataFrame, docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) of set_hash that connect every linked pair; classes: set_hash, prints and k, one of its rows (see simhash.id_order)."""
    near = components(candidates(classes.select("set_hash", "prints")))
    row = classes.select(F.col("set_hash").alias("node"), F.col("k.z").alias("z"), F.coalesce("k.doc_id", F.lit(0)).alias("id"), F.col("k.text_hash").alias("text_hash"))
    member = written(by_root(near, near.groupBy("root").agg(F.count(F.lit(1)).alias("m"))).join(row, "node"), "candidates")
    text = written(texts_of(member, docs), "texts")
    found = cut(linked(first_round(text, hot)))
    large = text.where(F.col("m") > hot)
    if large.isEmpty():
        return found
    sets = components(found)
    told = cut(large.select("node", "root").join(sets.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")))
    met = second_round(told, hot)
    found = sets.select(F.col("root").alias("a"), F.col("node").alias("b"))
    return found if met is None else found.unionByName(linked(large.select("node", "text").join(met, "node")))


def one_of_each(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row of each group of near copies, all columns as they were; which one, see simhash.one_of_each."""
    begun = made()
    each = written(sketches(docs), "shingles")
    classes = written(each.groupBy("set_hash").agg(F.first("prints").alias("prints"), F.min(id_order()).alias("k")), "classes")
    drop_made(docs.sparkSession, begun, begun + 1)  # the sketches: classes have all that is read again
    found = components(links(classes, docs, hot))
    drop_made(docs.sparkSession, begun + 1)  # candidates and their texts
    named = classes.join(found, classes["set_hash"] == found["node"], "left").select(F.coalesce("root", "set_hash").alias("root"), "k")
    return rows_that_stay(docs, named.groupBy("root").agg(F.min("k").alias("k")))
