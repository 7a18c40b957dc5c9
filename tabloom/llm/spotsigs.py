"""Document fingerprints by SpotSigs: chains of content words after common words.

A signature begins at an anchor (a very common word) and holds the next CHAIN
content words (words that are no anchors), whatever stands between.  A text's
fingerprint is the multiset of its signatures, as the set of 32-bit hashes of
(signature, how many times it came before), written as sorted hex; likeness is
the Jaccard index of two such sets, 0 at once if their sizes can't reach the floor.

`near_classes` joins whole collections: sets are partitioned by length into ranges
such that a pair of at least the wanted likeness lies in the same or neighbouring
ranges, candidates share one of each set's rarest signatures (prefix filter; a signature
of very many sets is dealt to several tasks) whose places leave enough others to share
(position filter), and candidates are verified by the pruned Jaccard.

Defined results: null text counts as empty.  Before the first anchor, and where GAP
words passed without one, every word is an anchor, so short texts, lists and other
languages have fingerprints too; a text with no chain at all is fingerprinted by its
whole word sequence, a text without words by the empty set.
Two empty sets have likeness 1, an empty and another 0.  Equal texts have equal
fingerprints.  Rows with equal doc_id are ordered by text, those without one come first;
repeated rows are each returned; very long texts are read whole; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lane, only, parts, table, words_of, written

CHAIN = 2
#: Words without an anchor after which each further one counts as an anchor itself.
GAP = 8
#: Very common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an and are as at be by for from has have he in is it its of on or she that the they this to was we were will with you "
    "das dem den der des die ein eine einem einen einer es für im ist mit nicht sich sie und von zu auf "
    "au aux avec ce cette dans du elle en est et il la le les ne par pas pour que qui sur un une "
    "al como con de del el ella las lo los más no para pero por se sin su sus una y".split()
)
#: Sets of a length range that share a signature, up to which one task compares them.
HOT = 1_000
#: Ranges of ids from which the ranges of like size are put together, for each of these.
FINER = 8
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def signatures(text: str | None, chain: int = CHAIN) -> set[int]:
    """Hashes of a text's spot signatures."""
    words = [w for w in (x if x.isalnum() else _EDGE.sub("", x) for x in words_of(text)) if w]
    if not words:
        return set()
    content: list[str] = []
    spots: list[tuple[str, int]] = []
    since = GAP
    for w in words:
        if w in ANCHORS:
            spots.append((w, len(content)))
            since = 0
        else:
            content.append(w)
            if since >= GAP:
                spots.append((w, len(content)))
            since += 1
    last = len(content) - chain
    joined = [" ".join([w, *content[k : k + chain]]) for w, k in spots if k <= last]
    if not joined:
        joined = [" ".join(words)]
    h = xxhash.xxh32_intdigest
    seen: dict[str, int] = {}
    out = set()
    for s in joined:
        k = seen[s] = seen.get(s, -1) + 1
        out.add(h(s, k))
    return out


def to_hex(sigs: set[int]) -> str:
    return np.sort(np.fromiter(sigs, ">u4", len(sigs))).astype(">u4").tobytes().hex()


def from_hex(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4")


def jaccard(a: set[int], b: set[int], floor: float = 0.0) -> float:
    """Jaccard index; 0 as soon as `floor` is out of reach."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < floor * len(large):
        return 0.0
    shared = len(small & large)
    value = shared / (len(a) + len(b) - shared)
    return value if value >= floor else 0.0


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id and fingerprint of every document; no shuffle."""

    def run(batches):
        for batch in batches:
            out = [to_hex(signatures(t, chain)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    slim = only(docs, "doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, fingerprint string")


def near_pairs(prints: DataFrame, floor: float = 0.8, hot: int = HOT) -> DataFrame:
    """Links (a, b, likeness) between names of fingerprint classes at least `floor` alike, a < b; prints: name, fingerprint, each class once."""
    if not 0.0 < floor <= 1.0:
        raise ValueError("the floor lies in (0, 1]")
    prints = prints.where("fingerprint <> ''")
    kind = dict(prints.dtypes)["name"]
    size = (F.length("fingerprint") / 8).cast("int")
    # in one walk over the text: substring() counts its characters from the start for each signature
    tokens = prints.select("name", size.alias("n"), F.explode(F.expr("regexp_extract_all(fingerprint, '.{8}', 0)")).alias("sig"))
    # a signature of one set alone links nothing: the set's places are counted without moving it again
    df = tokens.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # prefix filter: of a set of n, two alike sets share one of its n - ceil(floor n) + 1 rarest signatures, of which n - size(s) are its own
    ranked = tokens.join(df, "sig").groupBy("name", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("s"))
    own = F.expr("n - size(s)")
    within = F.expr(f"slice(s, 1, greatest(0, n - cast(ceil({floor} * n - 1e-9) as int) + 1 - (n - size(s))))")
    prefix = ranked.select("name", "n", own.alias("own"), F.posexplode(within).alias("k", "p"))
    # ranges of lengths, each `1/floor` times as long: a pair lies in the same or the next one
    band = F.lit(0) if floor == 1.0 else F.floor(F.log("n") / F.lit(-float(np.log(floor)))).cast("int")
    # rest: how many a pair can share if this signature is its first shared one
    rest = F.col("n") - F.col("own") - F.col("k")
    prefix = written(prefix.select("name", "n", rest.alias("rest"), F.col("p.sig").alias("sig"), band.alias("band")), "spots-prefix")
    # a partition of many sets is cut into blocks of `hot`: each set meets all of them, in as many tasks
    sizes = prefix.groupBy("sig", "band").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("sig", "band", F.ceil(F.col("m") / F.lit(hot)).cast("int").alias("blocks"))
    sizes = written(sizes, "spots-sizes")
    sizes = sizes.hint("broadcast") if sizes.count() <= 100_000 else sizes
    few = F.coalesce("blocks", F.lit(1))
    left = prefix.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), "sig", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    left = left.join(sizes, ["sig", "band"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), few - 1))).drop("blocks")
    right = prefix.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), "sig", "band").join(sizes, ["sig", "band"], "left")
    right = right.withColumn("block", F.pmod(F.xxhash64("b"), few).cast("int")).drop("blocks")
    # positions: an alike pair passes at its first shared signature, most others and most later signatures do not
    near = left.join(right, ["sig", "band", "block"]).where((F.col("a") < F.col("b")) & (F.least("ra", "rb") >= F.lit(floor / (1.0 + floor)) * (F.col("na") + F.col("nb")) - 1e-9) & (F.least("na", "nb") >= floor * F.greatest("na", "nb") - 1e-9))
    pairs = near.select("a", "b").distinct()
    texts = prints.select("name", F.unhex("fingerprint").alias("fingerprint"))
    both = pairs.join(texts.toDF("a", "fa"), "a").join(texts.toDF("b", "fb"), "b")

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            sets: dict = {}  # of this batch: a name comes in many pairs

            def of(name, prints, k, sets=sets):
                if name not in sets:
                    sets[name] = set(np.frombuffer(prints[k].as_py(), ">u4").tolist())
                return sets[name]

            keep = [(m, n, v) for k, (m, n) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)) if (v := jaccard(of(m, x, k), of(n, y, k), floor)) > 0]
            types = (a.type, b.type, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in keep], t) for i, t in enumerate(types)], names=["a", "b", "likeness"])

    return both.select("a", "b", "fa", "fb").mapInArrow(run, f"a {kind}, b {kind}, likeness double")


def near_classes(docs: DataFrame, floor: float = 0.8, chain: int = CHAIN, hot: int = HOT) -> DataFrame:
    """doc_id, class_id and n_links of every document.

    Documents of equal fingerprints form a class, whatever their ids; class_id is the
    smallest of these (null if none has one), n_links the number of other classes at least
    `floor` alike.  Groups of copies are one class and do not expand into pairs.
    """
    each = written(fingerprints(docs, chain).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("fingerprint").alias("name"), "fingerprint"), "spots")
    classes = each.groupBy("name").agg(F.any_value("fingerprint").alias("fingerprint"), F.min("doc_id").alias("class_id"))
    classes = written(classes.withColumn("number", F.monotonically_increasing_id()), "spots-classes")
    pairs = written(near_pairs(classes.select(F.col("number").alias("name"), "fingerprint"), floor, hot), "spots-pairs")
    ends = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("number")).agg(F.count(F.lit(1)).alias("n_links"))
    told = classes.select("name", "number", "class_id").join(ends, "number", "left").drop("number").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    return each.select("doc_id", "name").join(told, "name").select("doc_id", "class_id", "n_links")


def edited(text: str, following: str) -> str:
    """The last quarter replaced by the first as many characters of the next document."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Documents dealt to ranges of doc_id; rows of a range followed by the first document of the next one (last = true).

    The ranges' first documents are found by their ids alone, so the texts are
    shuffled once and no row waits for a global sort in a single task.
    """
    slim = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    fine = FINER * buckets if buckets > 1 else 1
    cuts = slim.select(F.percentile_approx(key, [k / fine for k in range(1, fine)] or [0.5], 100_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts)) if buckets > 1 else []
    # fine ranges by rows, put together to ranges of like characters; a binary search, so that thousands of ranges stay cheap
    place = _search(key, cuts)
    ranges = slim.groupBy(place.alias("place")).agg(F.min(key).alias("key"), (F.sum(F.coalesce(F.length("text"), F.lit(0))) + F.count(F.lit(1))).alias("size")).orderBy("place").collect()
    share, total, belongs, firsts = sum(r["size"] for r in ranges) / buckets, 0, {}, []
    for r in ranges:
        belongs[r["place"]] = b = min(buckets - 1, int((total + r["size"] / 2) / share))
        if not firsts or firsts[-1]["bucket"] != b:
            firsts.append({"bucket": b, "key": r["key"]})
        total += r["size"]
    bucket = F.element_at(F.array(*[F.lit(belongs.get(k, 0)) for k in range(len(cuts) + 1)]), place + 1)
    if not firsts:
        return slim.select(F.lit(0).alias("bucket"), "doc_id", "text", F.lit(False).alias("last"))
    before = {row["key"]: firsts[k - 1]["bucket"] for k, row in enumerate(firsts)}  # the very first follows the last range
    edge = F.create_map(*[F.lit(x).cast(t) for pair in before.items() for x, t in zip(pair, ("long", "int"), strict=True)])
    own = slim.select(bucket.alias("bucket"), "doc_id", "text", F.lit(False).alias("last"))
    heads = slim.where(key.isin([int(k) for k in before])).select(edge[key].alias("bucket"), "doc_id", "text", F.lit(True).alias("last"))
    return own.unionByName(heads)


def _search(key: F.Column, cuts: list[int]) -> F.Column:
    """How many of the sorted cuts are at most key."""

    def within(lo: int, hi: int) -> F.Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), within(lo, mid)).otherwise(within(mid + 1, hi))

    return within(0, len(cuts)).cast("int")


def edit_report(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Each document against its edited text and its successor."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        held = None  # (bucket, doc_id, text, signatures) that waits for its successor
        for batch in batches:
            out = []
            for bucket, doc_id, text, last in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                text = text or ""
                sigs = None
                if held and held[0] == bucket:
                    sigs = held[3] if held[2] == text else signatures(text, chain)
                    new = edited(held[2], text)
                    other = held[3] if new == held[2] else signatures(new, chain)
                    out.append((held[1], len(held[2]), hashlib.sha256(new.encode()).hexdigest(), to_hex(held[3]), to_hex(other), jaccard(held[3], other), jaccard(held[3], sigs)))
                if last:
                    held = None  # further rows of the next range's first id are its own
                else:
                    held = (bucket, doc_id, text, signatures(text, chain) if sigs is None else sigs)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], names=names)

    n = parts(docs.sparkSession)
    dealt = with_next(docs, n)
    dealt = dealt.withColumn("lane", lane(docs.sparkSession, n, F.col("bucket"))).repartition(n, "lane").drop("lane")
    dealt = dealt.sortWithinPartitions("bucket", "last", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    return dealt.mapInArrow(run, schema)


def spotsigs_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(table(spark, sf_dir, "documents"))
