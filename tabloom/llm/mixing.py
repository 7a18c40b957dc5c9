"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is (target share x rows wanted) / (its rows).
Each document draws its number of copies from the Poisson distribution of that
mean by inverting it at a uniform number that is a hash of seed and doc_id, so
the draw is repeatable, needs no state, and any executor draws the same.  The
document is exploded by its count, and all copies are sorted globally by another
hash of (seed, doc_id, copy), dealt out by equal ranges of that hash.

The mean over a source's documents is the target in expectation, and no source,
however large, is gathered anywhere: rates come from one count by source.

Defined results: a null source is a source of its own (target "", unless named);
a source without a target gets `other` (0 unless given); an empty or null text is a
document like any other, a very long one too; documents with equal doc_id, and repeated
rows, draw the same count; rows with equal keys stand in order of doc_id and copy; an empty
table gives no rows.  Columns named like the result's own (copy, shuffle_key) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lane, parts, table

SEED = "mix-1"
#: Target weight of a source of n rows: n to this power.  1 keeps the mix, 0 levels it.
TEMPER = 0.5
#: Means above this are drawn as a sum of equal Poisson parts, so the inversion's terms never vanish.
PART = 16.0
#: The rate table is broadcast if its sources' names and distributions fit in this many bytes; else the join is salted.
BROADCAST_BYTES = 4_000_000
SALTS = 64
_UNIT = 2.0**52


def uniform(*keys: F.Column) -> F.Column:
    """A number in (0, 1) from the first 52 bits of an md5 of the keys."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(_UNIT)


def pieces(mean: F.Column) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(mean / PART)).cast("int")


def distribution(mean: F.Column) -> F.Column:
    """The values of the Poisson distribution function at 0, 1, ..., 95 (beyond 1 - 2^-53 for a mean of PART), of mean / pieces."""
    share = mean / pieces(mean)
    start = F.struct(F.exp(-share).alias("term"), F.array(F.exp(-share)).alias("sums"))

    def step(acc, k):
        term = acc["term"] * share / k
        return F.struct(term.alias("term"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + term)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(95)), start, step, lambda acc: acc["sums"])


def poisson(sums: F.Column, n: F.Column, *keys: F.Column) -> F.Column:
    """A Poisson number: how many values of the distribution function lie at or below the uniform; the sum of n such draws."""

    def draw(u: F.Column) -> F.Column:
        return F.size(F.filter(sums, lambda x: x <= u))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + draw(uniform(*keys, i)))


def rates(counts: dict[str, int], weights: dict[str, float] | None = None, rows: float | None = None, temper: float = TEMPER, other: float = 0.0) -> dict[str, float]:
    """source -> mean copies of each of its documents."""
    weights = {k: float(n) ** temper for k, n in counts.items()} if weights is None else {k: float(weights.get(k, other)) for k in counts}
    if any(w < 0 or not math.isfinite(w) for w in weights.values()):
        raise ValueError("weights are finite and not negative")
    total = sum(weights[k] for k in sorted(weights))
    rows = float(sum(counts.values())) if rows is None else float(rows)
    return {k: (weights[k] / total * rows / n if total else 0.0) for k, n in counts.items()}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, rows: float | None = None, seed: str = SEED, temper: float = TEMPER, other: float = 0.0) -> DataFrame:
    """docs' columns, copy (1, 2, ...) and shuffle_key, in the global order of shuffle_key."""
    docs = docs.drop("copy", "shuffle_key")
    source = F.coalesce(F.col("source"), F.lit(""))
    per = docs.groupBy(source.alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    # the rate table stays a frame (one row a source, however many there are) and joins by source
    if weights is None:
        per = per.withColumn("__w", F.pow(F.col("__n").cast("double"), F.lit(temper)))
    elif weights:
        table_of = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], float(kv[1]))])
        per = per.withColumn("__w", F.coalesce(F.try_element_at(table_of, F.col("__source")), F.lit(float(other))))
    else:
        per = per.withColumn("__w", F.lit(float(other)))
    sums = per.agg(F.sum("__w").alias("w"), F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k"), F.max(F.length("__source")).alias("l")).first()
    total, wanted = float(sums["w"] or 0.0), float(sums["n"] or 0) if rows is None else float(rows)
    mean = F.col("__w") / F.lit(total if total else 1.0) * F.lit(wanted) / F.col("__n")
    # the distribution function is worked out once a source, and a row only looks its number up
    rate = per.where(mean > 0).select("__source", pieces(mean).alias("__pieces"), distribution(mean).alias("__sums"))
    if (sums["k"] or 0) * ((sums["l"] or 0) + 800) <= BROADCAST_BYTES:
        rated = docs.withColumn("__source", source).join(F.broadcast(rate), "__source")
    else:  # each source's rate once for every salt, so that a source of a third of all rows is dealt to SALTS tasks
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        salted = rate.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = docs.withColumn("__source", source).withColumn("__salt", salt).join(salted, ["__source", "__salt"])
    n = poisson(F.col("__sums"), F.col("__pieces"), F.lit(seed), F.col("doc_id"))
    copies = rated.withColumn("__copies", n).where("__copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    key = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary")), 1, 15)
    keyed = copies.withColumn("shuffle_key", F.conv(key, 16, 10).cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns], "copy", "shuffle_key")
    # the keys are evenly spread over 60 bits, so equal ranges of them are equal shares of the rows: no run to sample them
    n_parts = parts(docs.sparkSession)
    place = F.least(F.floor(F.col("shuffle_key") / F.lit(2.0**60) * n_parts).cast("int"), F.lit(n_parts - 1))
    dealt = keyed.withColumn("__lane", lane(docs.sparkSession, n_parts, place)).repartition(n_parts, "__lane").drop("__lane")
    return dealt.sortWithinPartitions("shuffle_key", "doc_id", "copy")


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: The same draw in DuckDB: terms by recursion, the count of those at or below the uniform.
OP7_SQL = f"""
WITH RECURSIVE per AS (
  SELECT coalesce(source, '') AS s, count(*) AS n, pow(count(*)::DOUBLE, {TEMPER}) AS w FROM documents GROUP BY 1
), rate AS (
  SELECT s, w / (SELECT sum(w) FROM per) * (SELECT sum(n) FROM per)::DOUBLE / n AS mean FROM per
), split AS (
  SELECT s, greatest(1, ceil(mean / {PART}))::INT AS pieces, mean / greatest(1, ceil(mean / {PART})) AS share FROM rate WHERE mean > 0
), term AS (
  SELECT s, 0 AS k, exp(-share) AS t, exp(-share) AS total FROM split
  UNION ALL
  SELECT term.s, k + 1, t * share / (k + 1), total + t * share / (k + 1) FROM term JOIN split USING (s) WHERE k < 95
), cdf AS (
  SELECT s, list(total ORDER BY k) AS totals FROM term GROUP BY s
), drawn AS (
  SELECT d.*, list_sum(list_transform(range(1, pieces + 1), lambda i:
    len(list_filter(totals, lambda x: x <= (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || i), 1, 13))::BIGINT::DOUBLE + 0.5) / {_UNIT!r})))) AS copies
  FROM documents d JOIN split ON coalesce(d.source, '') = split.s JOIN cdf ON cdf.s = split.s
), exploded AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies::BIGINT + 1))::INT AS copy FROM drawn WHERE copies > 0
)
SELECT *, ('0x' || substr(md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 15))::BIGINT AS shuffle_key FROM exploded
"""
