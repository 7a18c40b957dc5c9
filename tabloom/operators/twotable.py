"""merge, joinby, append."""

from __future__ import annotations

import warnings
from dataclasses import replace as changed

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import VerbError
from ..plans.view import Meta, View
from ..sources.names import valid_name
from .columns import check_ranges

MARKS = {"master": 1, "using": 2, "match": 4}
MERGE_LABEL = {1: "Master only (1)", 2: "Using only (2)", 3: "Matched (3)"}


def matched_keys(v: View, u: View, keys: list[str]) -> None:
    for k in keys:
        if k not in u.names:
            raise VerbError(f"variable {k} not found in the using data", 111)
        if v.kinds[k] != u.kinds[k]:
            raise VerbError(f"{k} is a string in one table and a number in the other", 106)


def must_be_unique(v: View, keys: list[str], side: str) -> None:
    twice = v.df.groupBy(*[v.key(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    if twice.count():
        raise VerbError(f"{' '.join(keys)} does not identify the rows of the {side} data", 459)


def _brought(v: View, u: View, keys: list[str], keepusing: str) -> list[str]:
    wanted = u.expand(keepusing) if keepusing else u.names
    wanted = [n for n in wanted if n not in keys]
    both = [n for n in wanted if n in v.names]
    if both:
        warnings.warn(f"in both tables, the master's are kept: {', '.join(both)}", stacklevel=4)
    return [n for n in wanted if n not in both]


def _labels(v: View, *using: View) -> dict[str, dict[int, str]]:
    """Value labels of all tables; of a name that two define otherwise, the first one's."""
    out = dict(v.value_labels)
    for u in using:
        for name, texts in u.value_labels.items():
            if out.setdefault(name, texts) != texts:
                warnings.warn(f"value label {name} differs between the tables: the master's is kept", stacklevel=4)
    return out


def _sides(v: View, u: View, keys: list[str], bring: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with comparable keys: numbers as numbers of one type, '' and NaN as missing."""
    cast = {k: "string" if v.kinds[k] == "s" else None for k in keys}
    same = {k: v.type_of(k) == u.type_of(k) for k in keys}

    def tagged(w: View, names: list[str], prefix: str) -> DataFrame:
        key = [(w.key(k) if same[k] or cast[k] else w.key(k).cast("double")).alias(f"__{prefix}{i}") for i, k in enumerate(keys)]
        return w.df.select(*key, *[F.col(f"`{n}`") for n in names])

    m = tagged(v, [n for n in v.df.columns if n not in keys], "m").withColumn("__in_m", F.lit(1))
    n = tagged(u, bring, "u").withColumn("__in_u", F.lit(1))
    return m, n


def merge(v: View, kind: str, keys: str, using: View, keep: str = "", keepusing: str = "", generate: str = "_merge", nogenerate: bool = False, check: bool = True) -> View:
    """merge 1:1, m:1 or 1:m on keys; missing keys match missing ones.

    The kept marks choose the join: a match alone is an inner join, with the master a
    left one, and so on, so that a small using table can be broadcast by Spark.
    """
    if kind == "m:m":
        raise VerbError("m:m pairs rows by their position: joinby makes all pairs")
    if kind not in ("1:1", "m:1", "1:m"):
        raise VerbError(f"unknown kind of merge {kind}")
    names = v.expand(keys, wild=False)
    matched_keys(v, using, names)
    bad = [w for w in keep.split() if w not in (*MARKS, "3", "1", "2")]
    if bad:
        raise VerbError(f"keep() takes match, master and using, not {bad[0]}")
    mask = sum({MARKS.get(w) or {"1": 1, "2": 2, "3": 4}[w] for w in keep.split()}) or 7
    if not nogenerate:
        valid_name(generate) if generate != "_merge" else None
        if generate in v.names or generate in using.names:
            raise VerbError(f"variable {generate} already defined", 110)
    check_ranges(using)
    if check:
        if kind in ("1:1", "1:m"):
            must_be_unique(v, names, "master")
        if kind in ("1:1", "m:1"):
            must_be_unique(using, names, "using")
    bring = _brought(v, using, names, keepusing)
    m, u = _sides(v, using, names, bring)
    on = [m[f"__m{i}"].eqNullSafe(u[f"__u{i}"]) for i in range(len(names))]
    how = {1: "left", 2: "right", 4: "inner", 5: "left", 6: "right"}.get(mask, "full_outer")
    j = m.join(u, on, how)
    mark = F.when(F.col("__in_m").isNull(), 2).when(F.col("__in_u").isNull(), 1).otherwise(3).cast("tinyint")
    if mask == 1:
        j = j.where(F.col("__in_u").isNull())
    elif mask == 2:
        j = j.where(F.col("__in_m").isNull())
    elif mask == 3:
        j = j.where(F.col("__in_m").isNull() | F.col("__in_u").isNull())
    outer = mask in (2, 3, 6, 7)
    cols = []
    for n in v.names:
        if n in names:
            i = names.index(n)
            cols.append(F.coalesce(f"__m{i}", f"__u{i}").alias(n))
        else:
            cols.append(_filled(n, v.kinds[n]) if outer else F.col(f"`{n}`"))
    cols += [_filled(n, using.kinds[n]) for n in bring]
    if not nogenerate:
        cols.append(mark.alias(generate))
    meta = {**{n: using.meta[n] for n in bring if n in using.meta}, **v.meta}
    labels = _labels(v, using)
    if not nogenerate:
        meta[generate] = Meta(label="matching result from merge", value_label="_merge")
        labels["_merge"] = MERGE_LABEL
    return v.then(j.select(*cols), f"merge {kind} {keys}", order=tuple((k, False) for k in names), meta=meta, value_labels=labels, paths=(*v.paths, *using.paths))


def _filled(name: str, kind: str):
    """A string that the other table lacks is the empty one."""
    return F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(name) if kind == "s" else F.col(f"`{name}`")


def merge_rows_in_turn(v: View, keys: str, using: View) -> View:
    """Within a key, row i takes row min(i, n) of each side: the sequential m:m rule."""
    names = v.expand(keys, wild=False)
    matched_keys(v, using, names)
    bring = _brought(v, using, names, "")
    m, u = _sides(v, using, names, bring)

    def ranked(df: DataFrame, p: str, rest: list[str]) -> DataFrame:
        ks = [f"__{p}{i}" for i in range(len(names))]
        w = Window.partitionBy(*ks)
        return df.withColumn(f"__r{p}", F.row_number().over(w.orderBy(*[F.col(f"`{n}`").asc_nulls_last() for n in rest]) if rest else w.orderBy(*ks))).withColumn(f"__n{p}", F.count(F.lit(1)).over(w))

    m, u = ranked(m, "m", [n for n in v.names if n not in names]), ranked(u, "u", bring)
    nm = m.groupBy(*[f"__m{i}" for i in range(len(names))]).agg(F.max("__nm").alias("__cm")).toDF(*[f"__a{i}" for i in range(len(names))], "__cm")
    nu = u.groupBy(*[f"__u{i}" for i in range(len(names))]).agg(F.max("__nu").alias("__cu")).toDF(*[f"__b{i}" for i in range(len(names))], "__cu")
    spine = nm.join(nu, [nm[f"__a{i}"].eqNullSafe(nu[f"__b{i}"]) for i in range(len(names))], "full_outer")
    spine = spine.select(*[F.coalesce(f"__a{i}", f"__b{i}").alias(f"__k{i}") for i in range(len(names))], "__cm", "__cu").withColumn("__i", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("__cm", F.lit(0)), F.coalesce("__cu", F.lit(0))))))
    j = spine.join(m, [spine[f"__k{i}"].eqNullSafe(m[f"__m{i}"]) for i in range(len(names))] + [F.least("__i", "__cm") == m["__rm"]], "left")
    j = j.join(u, [spine[f"__k{i}"].eqNullSafe(u[f"__u{i}"]) for i in range(len(names))] + [F.least("__i", "__cu") == u["__ru"]], "left")
    cols = [F.col(f"__k{names.index(n)}").alias(n) if n in names else _filled(n, v.kinds[n]) for n in v.names] + [_filled(n, using.kinds[n]) for n in bring]
    cols.append(F.when(F.col("__cm").isNull(), 2).when(F.col("__cu").isNull(), 1).otherwise(3).cast("tinyint").alias("_merge"))
    return v.then(j.select(*cols), f"merge m:m {keys}", order=tuple((k, False) for k in names), meta={**using.meta, **v.meta}, value_labels={**_labels(v, using), "_merge": MERGE_LABEL})


#: Pairs of a block of joinby, and rows that a block takes of either table.
BLOCK_PAIRS = 4_000_000
BLOCK_ROWS = 20_000


def _in_blocks(m: DataFrame, u: DataFrame, keys: int, names: tuple[list[str], list[str]]) -> DataFrame:
    """All pairs of rows of equal keys in the keys' order, missing ones last: blocks of rows are sorted, pairs never are.

    A key's rows are dealt to chunks on both sides, the longer side's to more of them, such
    that a chunk of one and a chunk of the other make BLOCK_PAIRS pairs or so.  Each two
    chunks are one row that is moved and sorted; its pairs are made after that, where it lies.
    """
    k, chunks = [f"__k{i}" for i in range(keys)], {}
    sides = {p: df.withColumn("__id", F.monotonically_increasing_id()).withColumnsRenamed({f"__{p}{i}": k[i] for i in range(keys)}) for p, df in (("m", m), ("u", u))}
    counts = {p: df.groupBy(*k).agg(F.count(F.lit(1)).alias(f"__c{p}")).withColumnsRenamed({c: f"{c}{p}" for c in k}) for p, df in sides.items()}
    both = counts["m"].join(counts["u"], [F.col(f"{c}m").eqNullSafe(F.col(f"{c}u")) for c in k])
    cm, cu = F.col("__cm").cast("double"), F.col("__cu").cast("double")
    blocks = F.ceil(cm * cu / F.lit(float(BLOCK_PAIRS)))
    # as many chunks as make both sides' of like size, but no more of a side than it has rows
    few = {"m": F.least(F.ceil(F.sqrt(blocks * cm / cu)), blocks, cm), "u": F.least(F.ceil(F.sqrt(blocks * cu / cm)), blocks, cu)}
    few = {p: F.greatest(F.lit(1), c, F.ceil(n / F.lit(float(BLOCK_ROWS)))).cast("long").alias(f"__n{p}") for (p, c), n in zip(few.items(), (cm, cu), strict=True)}
    for p, df in sides.items():
        shape = both.select(*[F.col(f"{c}m").alias(f"{c}s") for c in k], few[p])
        dealt = df.join(shape, [F.col(c).eqNullSafe(F.col(f"{c}s")) for c in k]).withColumn(f"__b{p}", F.pmod(F.xxhash64("__id"), F.col(f"__n{p}")))
        rows = F.struct(*[F.col(f"`{n}`") for n in names[p == "u"]], *[F.col(c).alias(f"__own{i}") for i, c in enumerate(k) if p == "m"], "__id")
        chunks[p] = dealt.groupBy(*k, f"__b{p}").agg(F.collect_list(rows).alias(f"__r{p}")).withColumnsRenamed({c: f"{c}{p}" for c in k})
    out = chunks["m"].join(chunks["u"], [F.col(f"{c}m").eqNullSafe(F.col(f"{c}u")) for c in k])
    order = [*[F.col(f"{c}m").asc_nulls_last() for c in k], F.col("__bm"), F.col("__bu")]
    # so many ranges, however few bytes the blocks have: it is their pairs that cost time
    out = out.repartitionByRange(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    out = out.select(F.explode("__rm").alias("__pm"), "__ru").select("__pm", F.explode("__ru").alias("__pu"))
    # a row's own key: that of its group has no negative zero
    return out.select(*[F.col(f"__pm.__own{i}").alias(c) for i, c in enumerate(k)], *[F.col(f"__p{p}.`{n}`").alias(n) for p, side in zip("mu", names, strict=True) for n in side])


def joinby(v: View, keys: str, using: View) -> View:
    """All pairs of rows with equal keys; shown or saved as they are, they come in the keys' order without a sort of the pairs."""
    names = v.expand(keys, wild=False)
    matched_keys(v, using, names)
    check_ranges(using)
    bring = _brought(v, using, names, "")
    m, u = _sides(v, using, names, bring)
    j = m.join(u, [m[f"__m{i}"].eqNullSafe(u[f"__u{i}"]) for i in range(len(names))], "inner")
    cols = [F.col(f"__m{names.index(n)}").alias(n) if n in names else F.col(f"`{n}`") for n in v.names]
    out = v.then(j.select(*cols, *[F.col(f"`{n}`") for n in bring]), f"joinby {keys}", order=tuple((k, False) for k in names), meta={**{n: using.meta[n] for n in bring if n in using.meta}, **v.meta}, value_labels=_labels(v, using), paths=(*v.paths, *using.paths))
    blocks = _in_blocks(m, u, len(names), ([n for n in v.names if n not in names], bring))
    dealt = blocks.select(*[F.col(f"__k{names.index(n)}").alias(n) if n in names else F.col(f"`{n}`") for n in out.names])
    return changed(out, in_order=(out.df, out.order, dealt))


def append(v: View, *using: View, generate: str = "") -> View:
    """Rows of all tables by name; a variable that one lacks is missing there."""
    if generate:
        valid_name(generate)
    if generate and any(generate in w.names for w in (v, *using)):
        raise VerbError(f"variable {generate} already defined", 110)
    kinds, out, meta, labels = dict(v.kinds), None, dict(v.meta), _labels(v, *using)
    for w in using:
        check_ranges(w)
        for n, k in w.kinds.items():
            if kinds.setdefault(n, k) != k:
                raise VerbError(f"{n} is a string in one table and a number in the other", 106)
        meta = {**w.meta, **meta}
    types: dict[str, set[str]] = {}
    for w in (v, *using):
        for n in w.names:
            types.setdefault(n, set()).add(w.type_of(n).simpleString())
    whole = ["tinyint", "smallint", "int", "bigint"]
    for i, w in enumerate((v, *using)):
        cols = []
        for n in kinds:
            if n in w.names:
                t = types[n]
                wide = None if len(t) == 1 else (whole[max(map(whole.index, t))] if t <= set(whole) else "double")
                cols.append(F.col(f"`{n}`").cast(wide).alias(n) if wide else F.col(f"`{n}`"))
            else:
                cols.append(F.lit("" if kinds[n] == "s" else None).cast("string" if kinds[n] == "s" else sorted(types[n])[0] if len(types[n]) == 1 else "double").alias(n))
        df = w.df.select(*cols, *([F.lit(i).cast("tinyint").alias(generate)] if generate else []))
        out = df if out is None else out.unionByName(df)
    return v.then(out, "append", order=(), meta=meta, value_labels=labels, paths=(*v.paths, *[p for w in using for p in w.paths]))


def append_in(v: View, using: View, keep: str = "", force: bool = False) -> View:
    """append of some of a table's variables; with force, one that is a string in one table and a number in the other is missing there."""
    if keep:
        using = _only(using, keep)
    other = [n for n in using.names if n in v.names and using.kinds[n] != v.kinds[n]]
    if other and force:
        blank = [F.lit("" if v.kinds[n] == "s" else None).cast(v.type_of(n)).alias(n) if n in other else F.col(f"`{n}`") for n in using.names]
        using = using.then(using.df.select(*blank), "force", order=(), meta={n: m for n, m in using.meta.items() if n not in other})
    return append(v, using)


def _only(v: View, names: str) -> View:
    from .columns import keep

    return keep(v, names)


def merge_report(v: View, generate: str = "_merge") -> dict[str, int]:
    """How many rows came from the master alone, the using table alone, and both."""
    per = {r["m"]: r["n"] for r in v.df.groupBy(F.col(f"`{generate}`").alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {text: per.get(k, 0) for k, text in MERGE_LABEL.items()}


def merge_in(
    v: View, kind: str, keys: str, using: View, update: bool = False, replace: bool = False, asserted: str = "", force: bool = False, nolabel: bool = False, nonotes: bool = False, noreport: bool = True, **options
) -> View:
    """merge with update (fill missing values), replace (also overwrite by nonmissing ones) and assert().

    force: of a variable that is a string in one table and a number in the other, the master's
    values stay; nolabel and nonotes: the using table's value labels and notes are not taken;
    noreport: the counts of merge_report are not printed.
    """
    using = changed(using, value_labels={} if nolabel else using.value_labels)
    out = _merged_in(v, kind, keys, using, update, replace, asserted, force, **options)
    if not nonotes:
        out = changed(out, notes=(*v.notes, *[n for n in using.notes if n not in v.notes]))
    if not noreport and options.get("generate", "_merge") in out.names:
        for text, n in merge_report(out, options.get("generate", "_merge")).items():
            print(f"{text:20} {n:>12}")
    return out


def _merged_in(v: View, kind: str, keys: str, using: View, update: bool, replace: bool, asserted: str, force: bool, **options) -> View:
    if kind == "m:m":
        return merge_rows_in_turn(v, keys, using)
    names = v.expand(keys, wild=False)
    if force:
        using = _only(using, " ".join(n for n in using.names if n in names or n not in v.names or using.kinds[n] == v.kinds[n]))
    shared = [n for n in using.names if n in v.names and n not in names]
    if (update or replace) and shared:
        for n in shared:
            if v.kinds[n] != using.kinds[n]:
                raise VerbError(f"{n} is a string in one table and a number in the other", 106)
        renamed = using
        from .columns import rename

        for n in shared:
            renamed = rename(renamed, n, f"_u_{n}"[:32])
        out = merge(v, kind, keys, renamed, **options)
        df = out.df
        for n in shared:
            new, old = F.col(f"`{f'_u_{n}'[:32]}`"), F.col(f"`{n}`")
            gone = (old == "") if v.kinds[n] == "s" else old.isNull()
            there = (new != "") if v.kinds[n] == "s" else new.isNotNull()
            df = df.withColumn(n, F.when((F.lit(replace) | F.coalesce(gone, F.lit(True))) & F.coalesce(there, F.lit(False)), new.cast(v.type_of(n))).otherwise(old))
        out = out.then(df.drop(*[f"_u_{n}"[:32] for n in shared]), "update", order=out.order)
    else:
        out = merge(v, kind, keys, using, **options)
    if asserted:
        allowed = [{"master": 1, "using": 2, "match": 3}[w] for w in asserted.split()]
        mark = options.get("generate", "_merge")
        if out.df.where(~F.col(mark).isin(allowed)).limit(1).count():
            raise VerbError(f"not all rows are {asserted}", 9)
    return out
