"""collapse, contract, duplicates, egen."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import VerbError
from ..functions.values import is_storage, stored
from ..plans.folder import fixed
from ..plans.view import Meta, View
from ..sources.names import valid_name

STATS = ("mean", "sd", "sum", "min", "max", "count", "median", "first", "last", "firstnm", "lastnm")
ITEM = re.compile(r"\(\s*(\w+)\s*\)|(\w+)\s*=\s*([\w*?]+)|([\w*?]+)")


def percentile_of(stat: str) -> float | None:
    if stat == "median":
        return 50.0
    m = re.fullmatch(r"p(\d{1,2})", stat)
    return float(m[1]) if m and 0 < int(m[1]) < 100 else None


#: Rows of a group from which its percentiles come from ranks dealt over partitions instead of an array in one task.
LARGE_GROUP = 1_000_000


def percentile_at(a: Column, p: float) -> Column:
    """Of n sorted values: with k = n p / 100, the mean of the k-th and next if k is whole, else the value at the next rank.

    The ranks are integer arithmetic (100 k = n p), so no rounding picks a neighbour.
    """
    q = int(p)
    np_ = F.size(a) * q
    k = (np_ / 100).cast("int")
    at = F.when(np_ % 100 == 0, (F.element_at(a, F.greatest(k, F.lit(1))) + F.element_at(a, F.least(k + 1, F.size(a)))) / 2).otherwise(F.element_at(a, F.least(k + 1, F.size(a))))
    return F.when(F.size(a) > 0, at)


def parse_collapse(v: View, text: str) -> list[tuple[str, str, str]]:
    """(stat, target, source) of "(mean) wage age (sum) total=wage"."""
    stat, out = "mean", []
    for m in ITEM.finditer(text):
        if m[1]:
            stat = m[1]
            if stat not in STATS and percentile_of(stat) is None:
                raise VerbError(f"unknown statistic {stat}")
        elif m[2]:
            out += [(stat, m[2], s) for s in v.expand(m[3])]
        else:
            out += [(stat, s, s) for s in v.expand(m[4])]
    if not out:
        raise VerbError("nothing to collapse")
    if "[" in text:
        raise VerbError("weights are not supported", 101)
    return out


def aggregate(v: View, stat: str, source: str, rank: Column | None = None) -> Column:
    string = v.kinds[source] == "s"
    c = F.col(f"`{source}`")
    if string and stat not in ("count", "first", "last", "firstnm", "lastnm"):
        raise VerbError(f"{stat} of the string variable {source}", 109)
    x = c if string else c.cast("double")
    there = F.coalesce(c != "", F.lit(False)) if string else c.isNotNull()
    if stat == "mean":
        return F.avg(x)
    if stat == "sd":
        return F.stddev_samp(x)
    if stat == "sum":
        return F.coalesce(F.sum(x), F.lit(0.0))
    if stat in ("min", "max"):
        return F.min(c) if stat == "min" else F.max(c)
    if stat == "count":
        return F.count(F.when(there, 1))
    if stat in ("first", "last"):
        return (F.min_by if stat == "first" else F.max_by)(c, rank)
    if stat in ("firstnm", "lastnm"):
        return (F.min_by if stat == "firstnm" else F.max_by)(c, F.when(there, rank))
    raise VerbError(f"{stat} is no aggregate of a row at a time", 198)


def grouped(df: DataFrame, keys: list[str], aggs: list[Column], wanted: list[tuple[str, str, float]], large: int | None = None) -> DataFrame:
    """keys, aggs, and a column for each (name, source, p) of wanted: the exact percentiles of the group's values.

    A count of each group's rows comes first.  While the largest group stays under
    LARGE_GROUP rows, a group's values are one array, sorted once a source; beyond
    it, values are ranked across partitions.  Both give the same result.
    """
    sources = sorted({src for _, src, _ in wanted})
    if not wanted:
        return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    large = LARGE_GROUP if large is None else large
    rows = df.count()  # no group is larger than the table
    if rows > large and keys:
        rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    if (rows or 0) <= large:
        lists = [F.collect_list(F.col(f"`{src}`").cast("double")).alias(f"__a{i}") for i, src in enumerate(sources)]
        out = df.groupBy(*keys).agg(*aggs, *lists) if keys else df.agg(*aggs, *lists)
        out = out.withColumns({f"__a{i}": F.array_sort(f"__a{i}") for i in range(len(sources))})
        return out.withColumns({t: percentile_at(F.col(f"__a{sources.index(src)}"), p) for t, src, p in wanted}).drop(*[f"__a{i}" for i in range(len(sources))])
    ranked = ranked_percentiles(df, keys, sources, wanted)
    names = [t for t, _, _ in wanted]
    if not keys:
        row = ranked.first()
        return df.agg(F.count(F.lit(1)).alias("__rows"), *aggs).drop("__rows").withColumns({t: F.lit(row[t]).cast("double") for t in names})
    out = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*[F.col(f"`{k}`") for k in keys]).distinct()
    other = ranked.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(f"`{t}`") for t in names])
    on = [out[f"`{k}`"].eqNullSafe(other[f"__k{i}"]) for i, k in enumerate(keys)]
    return out.join(other, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def ranked_percentiles(df: DataFrame, keys: list[str], sources: list[str], wanted: list[tuple[str, str, float]]) -> DataFrame:
    """Percentiles by ranks: no task holds a group.

    A group's values are counted (partial counts before the shuffle), dealt by
    ranges of (keys, source, value), and each range's count shifts the ranks of
    the ranges after it; a group has at most one such count a partition.
    """
    by = [F.col(f"`{k}`") for k in keys]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{src}`").cast("double").alias("x")) for i, src in enumerate(sources)]))
    names = [f"__g{i}" for i in range(len(keys))]
    values = df.select(*[k.alias(g) for k, g in zip(by, names, strict=True)], cells.alias("c")).select(*names, "c.i", "c.x").where("x IS NOT NULL")
    counts = values.groupBy(*names, "i", "x").agg(F.count(F.lit(1)).alias("n"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = fixed(counts.repartitionByRange(parts, *names, "i", "x").withColumn("p", F.spark_partition_id()))
    group = [*names, "i"]
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    spans = dealt.groupBy(*group, "p").agg(F.sum("n").alias("s"))
    spans = spans.select(*[F.col(g).alias(f"{g}_") for g in group], F.col("p").alias("p_"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"), F.sum("s").over(whole).alias("total"))
    on = [dealt[g].eqNullSafe(spans[f"{g}_"]) for g in names] + [dealt["i"] == spans["i_"], dealt["p"] == spans["p_"]]
    up = F.sum("n").over(Window.partitionBy(*group, "p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranks = dealt.join(spans, on).select(*group, "x", "n", "total", (F.col("before") + up).alias("hi"))
    ends = {}
    for t, src, p in wanted:
        k, whole_rank = F.expr(f"total * {int(p)} div 100"), F.col("total") * int(p) % 100 == 0
        mine = F.col("i") == sources.index(src)
        ends[t] = [mine & (r > F.col("hi") - F.col("n")) & (r <= F.col("hi")) for r in (F.when(whole_rank, F.greatest(k, F.lit(1))).otherwise(k + 1), F.least(k + 1, F.col("total")))]
    any_end = None
    for low, high in ends.values():
        any_end = low | high if any_end is None else any_end | low | high
    at = [((F.max(F.when(low, F.col("x"))) + F.max(F.when(high, F.col("x")))) / 2).alias(t) for t, (low, high) in ends.items()]
    found = ranks.where(any_end)
    out = found.groupBy(*names).agg(*at) if names else found.agg(*at)
    return out.select(*[F.col(g).alias(k) for g, k in zip(names, keys, strict=True)], *[F.col(f"`{t}`") for t in ends])


def by_keys(v: View, by: str | list[str]) -> list[str]:
    return v.expand(by, wild=False) if by else []


def collapse(v: View, text: str, by: str | list[str] = "") -> View:
    keys = by_keys(v, by)
    items = parse_collapse(v, text)
    targets = [t for _, t, _ in items]
    if len(set(targets)) < len(targets) or set(targets) & set(keys):
        raise VerbError("a result is named twice")
    for t in targets:
        valid_name(t)
    df = v.df
    # what comes first is the smallest of the order's keys and, among equal ones, of the values asked for: no row numbers
    placed = list(dict.fromkeys(src for s, _, src in items if s in ("first", "last", "firstnm", "lastnm")))
    rank = F.struct(*v.rank_keys(), *[x for n in placed for x in (F.col(f"`{n}`").isNull(), F.col(f"`{n}`"))]) if placed else None
    ranked = [(t, src, percentile_of(s)) for s, t, src in items if percentile_of(s) is not None]
    for t, src, _ in ranked:
        if v.kinds[src] == "s":
            raise VerbError(f"percentile of the string variable {src}", 109)
    aggs = [aggregate(v, s, src, rank).alias(t) for s, t, src in items if percentile_of(s) is None]
    # keys under other names, as a source may be a key too
    tags = [f"__by{i}" for i in range(len(keys))]
    df = df.withColumns({g: v.key(k) for g, k in zip(tags, keys, strict=True)}) if keys else df
    out = grouped(df, tags, aggs if keys else [*aggs, F.count(F.lit(1)).alias("__n")], ranked)
    if not keys:
        out = out.where("__n > 0")
    out = out.select(*[F.col(g).alias(k) for g, k in zip(tags, keys, strict=True)], *[F.col(f"`{t}`") for t in targets])
    meta = {k: v.meta[k] for k in keys if k in v.meta}
    meta |= {t: Meta(label=f"({s}) {src}", fmt=v.meta.get(src, Meta()).fmt if s not in ("count", "sd") else "") for s, t, src in items}
    return v.then(out, f"collapse {text}{', by(' + ' '.join(keys) + ')' if keys else ''}", order=tuple((k, False) for k in keys), meta=meta)


def contract(v: View, names: str, freq: str = "_freq") -> View:
    keys = v.expand(names)
    if freq in keys:
        raise VerbError(f"variable {freq} already defined", 110)
    out = v.df.groupBy(*[v.key(k).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias(freq))
    return v.then(out, f"contract {names}", order=tuple((k, False) for k in keys))


def duplicates_drop(v: View, names: str = "", force: bool = False) -> View:
    """One row of each set of equal rows; by some variables only with force and a sort, the first in order."""
    if not names:
        hidden = [n for n in v.df.columns if n not in v.names]
        out = v.df.groupBy(*[v.key(n).alias(f"__k{i}") for i, n in enumerate(v.names)]).agg(*[F.any_value(F.col(f"`{n}`")).alias(n) for n in [*v.names, *hidden]])
        return v.then(out.select(*[F.col(f"`{n}`") for n in v.df.columns]), "duplicates drop")
    keys = v.expand(names)
    if not force or not v.order:
        raise VerbError("duplicates drop of some variables needs force and a declared sort")
    # the smallest row of a group by an aggregate, so that a hot key is reduced before it is dealt
    whole = F.struct(*[F.col(f"`{n}`") for n in v.df.columns])
    rank = F.struct(*v.rank_keys(), *[x for n in v.names for x in (F.col(f"`{n}`").isNull(), F.col(f"`{n}`"))])
    out = v.df.groupBy(*[v.key(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(whole, rank).alias("__row")).select("__row.*")
    return v.then(out, f"duplicates drop {names}, force")


EGEN = ("total", "mean", "sd", "min", "max", "count")


def egen(v: View, name: str, function: str, expression: str, by: str = "", storage: str = "double") -> View:
    """A statistic of the row's group in every row: aggregate and join, so a hot group is not one task's window."""
    valid_name(name)
    if name in v.names:
        raise VerbError(f"variable {name} already defined", 110)
    if function not in EGEN:
        raise VerbError(f"unknown egen function {function}", 133)
    if not is_storage(storage) or storage.startswith("str"):
        raise VerbError("egen makes a number", 109)
    x, _ = v.value(expression)
    if x.kind == "s":
        raise VerbError("egen takes a number", 109)
    c = (F.when(x.col, 1.0).when(~x.col, 0.0) if x.kind == "b" else x.col.cast("double"))
    agg = {"total": F.coalesce(F.sum("__x"), F.lit(0.0)), "mean": F.avg("__x"), "sd": F.stddev_samp("__x"), "min": F.min("__x"), "max": F.max("__x"), "count": F.count("__x").cast("double")}[function]
    keys = by_keys(v, by)
    tagged = [v.key(k) for k in keys]
    if keys:
        df = v.df.withColumns({"__x": c, **{f"__k{i}": k for i, k in enumerate(tagged)}})
        per = df.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(agg.alias("__v")).select(*[F.col(f"__k{i}").alias(f"__j{i}") for i in range(len(keys))], "__v")
        on = [df[f"__k{i}"].eqNullSafe(per[f"__j{i}"]) for i in range(len(keys))]
        df = df.join(per, on, "left")
    else:
        per = v.df.withColumn("__x", c).agg(agg.alias("__v")).first()["__v"]
        df = v.df.withColumn("__v", F.lit(per).cast("double"))
    out = df.withColumn(name, stored(F.col("__v"), storage)).select(*[F.col(f"`{n}`") for n in [*v.df.columns, name]])
    return v.then(out, f"egen {name} = {function}({expression}){', by(' + by + ')' if by else ''}", meta={**v.meta, name: Meta(storage=storage)})
