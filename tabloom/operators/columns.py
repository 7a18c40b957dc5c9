"""One-table verbs: rows, columns, order, slices, samples."""

from __future__ import annotations

import re
from dataclasses import replace as changed

from pyspark.sql import functions as F

from ..errors import VerbError, not_found
from ..functions.values import finite, is_storage, stored
from ..plans.view import Meta, View, numbered
from ..sources.names import valid_name


def keep(v: View, names: str) -> View:
    """Projection in the named order."""
    got = v.expand(names)
    df, order = v.df, v.order
    for n in [n for n, _ in v.order if n not in got and not n.startswith("__o")]:
        df, order = changed(v, df=df, order=order).baked(n)
    hidden = [n for n, _ in order if n.startswith("__o")]
    return v.then(df.select(*[F.col(f"`{n}`") for n in [*got, *hidden]]), f"keep {names}", order=order)


def drop(v: View, names: str) -> View:
    gone = v.expand(names)
    rest = [n for n in v.names if n not in gone]
    if not rest:
        raise VerbError("drop would leave no variable")
    out = keep(v, " ".join(rest))
    return changed(out, steps=(*v.steps, f"drop {names}"))


def keep_if(v: View, condition: str) -> View:
    """Rows for which the condition is true (unknown rows go)."""
    c, uses = v.condition(condition, rows=True)
    return v.then(v.plain(v.with_rows(uses).where(c)), f"keep if {condition}")


def drop_if(v: View, condition: str) -> View:
    """Rows for which the condition is not true (unknown rows stay)."""
    c, uses = v.condition(condition, rows=True)
    return v.then(v.plain(v.with_rows(uses).where(~F.coalesce(c, F.lit(False)))), f"drop if {condition}")


def gen(v: View, name: str, expression: str, storage: str = "", condition: str = "") -> View:
    """A new variable; missing where the condition is false or unknown."""
    valid_name(name)
    if name in v.names:
        raise VerbError(f"variable {name} already defined", 110)
    x, uses = v.value(expression, rows=True)
    string = x.kind == "s"
    if storage and not is_storage(storage):
        raise VerbError(f"unknown storage type {storage}")
    if storage and storage.startswith("str") != string:
        raise VerbError("the storage type does not fit the expression", 109)
    col = F.coalesce(x.col, F.lit("")) if string else (F.when(x.col, 1.0).when(~x.col, 0.0) if x.kind == "b" else x.col if x.sure else finite(x.col.cast("double")))
    if condition:
        c, more = v.condition(condition)
        uses = uses | more
        col = F.when(F.coalesce(c, F.lit(False)), col).otherwise(F.lit("" if string else None))
    col = stored(col, storage) if storage else col
    df = v.plain(v.with_rows(uses).withColumn(name, col))
    return v.then(df, f"gen {storage + ' ' if storage else ''}{name} = {expression}{' if ' + condition if condition else ''}", meta={**v.meta, name: Meta(storage=storage)})


def replace(v: View, name: str, expression: str, condition: str = "") -> View:
    """New values where the condition is true; the variable keeps its place, and is widened rather than cut."""
    if name not in v.names:
        raise not_found(name)
    x, uses = v.value(expression)
    if (x.kind == "s") != (v.kinds[name] == "s"):
        raise VerbError("the expression is of another kind than the variable", 109)
    df, order = v.baked(name)
    old = F.col(f"`{name}`")
    if x.kind == "s":
        new = F.coalesce(x.col, F.lit(""))
    else:
        kind = kept_type(v, name, expression)
        new = F.when(x.col, 1.0).when(~x.col, 0.0) if x.kind == "b" else x.col if x.sure else finite(x.col.cast("double"))
        new, old = new.cast(kind), old.cast(kind)
    if condition:
        c, _ = v.condition(condition)
        new = F.when(F.coalesce(c, F.lit(False)), new).otherwise(old)
    was = v.meta.get(name, Meta())
    meta = changed(was, storage=was.storage if x.kind != "s" and v.type_of(name).simpleString() == kind and expression.strip() == "." else "")
    return v.then(df.withColumn(name, new), f"replace {name} = {expression}{' if ' + condition if condition else ''}", order=order, meta={**v.meta, name: meta})


def kept_type(v: View, name: str, expression: str) -> str:
    """The type of a number after replace: its own if no value can need more, a wider whole number, else double.

    Sums, differences and products of whole numbers are whole; a missing value fits any type.
    """
    whole, old = ("tinyint", "smallint", "int", "bigint"), v.type_of(name).simpleString()
    if expression.strip() == ".":
        return old if old in (*whole, "float") else "double"
    words = re.findall(r"[A-Za-z_]\w*|[0-9.]+|\S", expression)
    kinds = []
    for w in words:
        if re.fullmatch(r"[0-9]{1,9}", w):
            kinds.append(next(t for t, most in (("tinyint", 127), ("smallint", 32767), ("int", 2**31)) if int(w) <= most))
        elif w in v.names:
            kinds.append(v.type_of(w).simpleString())
        elif w not in "+-*()":
            return "double"
    if not set(kinds) <= {*whole, "float"} or old not in (*whole, "float"):
        return "double"
    if old == "float" or "float" in kinds:
        return "float" if old == "float" and (len(words) == 1 or "float" not in kinds) else "double"
    if any(w in "+-*" for w in words):
        return "bigint"
    return max([old, *kinds], key=whole.index)


def label_define(v: View, name: str, texts: dict[int, str]) -> View:
    """A value label: texts of whole numbers."""
    valid_name(name)
    return changed(v, value_labels={**v.value_labels, name: {int(k): str(t) for k, t in texts.items()}})


def label_values(v: View, names: str, label: str = "") -> View:
    """Attach a value label to numbers; none takes it off."""
    got = v.expand(names)
    if label and label not in v.value_labels:
        raise VerbError(f"value label {label} not found", 111)
    if any(v.kinds[n] == "s" for n in got):
        raise VerbError("a string has no value label", 181)
    return changed(v, meta={**v.meta, **{n: changed(v.meta.get(n, Meta()), value_label=label) for n in got}})


def note(v: View, text: str) -> View:
    """A note on the data; it is saved and read back with them."""
    return changed(v, notes=(*v.notes, text))


def char(v: View, name: str, key: str, text: str) -> View:
    """A characteristic of a variable; an empty text takes it off."""
    v.expand(name, wild=False)
    valid_name(key)
    m = v.meta.get(name, Meta())
    rest = tuple((k, t) for k, t in m.chars if k != key)
    return changed(v, meta={**v.meta, name: changed(m, chars=(*rest, (key, text)) if text else rest)})


def rename(v: View, old: str, new: str) -> View:
    """rename(v, "a", "b"), or simultaneously rename(v, "a b", "b a")."""
    olds, news = old.split(), new.split()
    if len(olds) != len(news) or len(set(olds)) < len(olds) or len(set(news)) < len(news):
        raise VerbError("as many different new names as old ones are needed")
    for n in olds:
        if n not in v.names:
            raise not_found(n)
    to = dict(zip(olds, news, strict=True))
    for n in news:
        valid_name(n)
        if n in v.names and n not in to:
            raise VerbError(f"variable {n} already defined", 110)
    df = v.df.select(*[F.col(f"`{n}`").alias(to.get(n, n)) for n in v.df.columns])
    return v.then(df, f"rename ({old}) ({new})", order=tuple((to.get(n, n), d) for n, d in v.order), meta={to.get(n, n): m for n, m in v.meta.items()})


def order(v: View, names: str) -> View:
    """The named variables first."""
    first = v.expand(names)
    rest = [n for n in v.df.columns if n not in first]
    return v.then(v.df.select(*[F.col(f"`{n}`") for n in [*first, *rest]]), f"order {names}")


def sort(v: View, names: str) -> View:
    got = v.expand(names, wild=False)
    return v.then(v.df.drop(*[c for c in v.df.columns if c.startswith("__o")]), f"sort {names}", order=tuple((n, False) for n in got))


def gsort(v: View, names: str) -> View:
    """Mixed directions, "-wage +id"; missing values last in either."""
    keys = []
    for word in names.replace("- ", "-").replace("+ ", "+").split():
        n = word.lstrip("+-")
        v.expand(n, wild=False)
        keys.append((n, word.startswith("-")))
    if not keys:
        raise VerbError("no variables are named")
    return v.then(v.df.drop(*[c for c in v.df.columns if c.startswith("__o")]), f"gsort {names}", order=tuple(keys))


def keep_in(v: View, first: int, last: int | None = None) -> View:
    """Rows first to last in the view's order; that they exist is checked when rows are asked for."""
    last = first if last is None else last
    if not 1 <= first <= last:
        raise VerbError(f"in {first}/{last}: no such rows")
    cut = numbered(v.df, v.rank_keys(), "__row_n", first, last).drop("__row_n")
    return v.then(cut, f"keep in {first}/{last}", ranges=(*v.ranges, (v.df, first, last)))


def sample(v: View, size: float, count: bool = False, seed: int = 1) -> View:
    """Exactly `size` percent of the rows (rounded), or `size` rows: those with the smallest draws.

    A row's draw is a hash of the seed and its values, so the sample is the same on every
    run; of equal rows as many stay as fit.  Three counts by ever finer ranges of the draw find
    the last one that fits, and a filter keeps what lies below: rows are neither sorted nor gathered.
    """
    if count and (size < 1 or size != int(size)) or not count and not 0 < size <= 100:
        raise VerbError("sample takes a percentage in (0, 100], or a number of rows")
    told = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in v.names]
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *told).cast("binary")), 1, 15), 16, 10).cast("long")
    df = v.df.withColumn("__d", draw)
    drawn, below, prefix = df.select("__d"), 0, 0
    n = None
    for shift in (40, 20, 0):
        level = drawn if n is None else drawn.where(F.shiftright("__d", shift + 20) == prefix)
        sizes = sorted((r["b"], r["n"]) for r in level.groupBy(F.shiftright("__d", shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())  # 2^20 at most
        if n is None:
            rows_ = sum(k for _, k in sizes)
            n = min(int(size) if count else int(rows_ * size / 100 + 0.5), rows_)
            if n == rows_:
                return v.then(v.df, f"sample {size}")
        for prefix, k in sizes:
            if below + k > n:
                break
            below += k
    kept = df.where(F.col("__d") < prefix).drop("__d")
    if below < n:  # some of the rows that share one draw: as many copies as are lacking, of the smallest rows
        names = [F.col(f"`{c}`") for c in v.df.columns]
        tied = df.where(F.col("__d") == prefix).groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).orderBy(*names).limit(n - below).collect()  # one row, but for a collision of hashes
        for r in tied:
            k = min(r["__n"], n - below)
            below += k
            if k:
                kept = kept.unionByName(v.df.sparkSession.range(k).select(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in v.df.schema]))
    return v.then(kept, f"sample {size}")


def label(v: View, name: str, text: str) -> View:
    v.expand(name, wild=False)
    return changed(v, meta={**v.meta, name: changed(v.meta.get(name, Meta()), label=text)})


def fmt(v: View, name: str, text: str) -> View:
    """The display format: %td and %tc make a number a date or a time when it is saved."""
    v.expand(name, wild=False)
    if v.kinds[name] == "s" and not text.endswith("s"):
        raise VerbError("a string has a string format", 109)
    return changed(v, meta={**v.meta, name: changed(v.meta.get(name, Meta()), fmt=text)})


def head(v: View, n: int = 5):
    if n < 1:
        raise VerbError("head takes at least one row")
    check_ranges(v)
    return v.sorted_df().limit(n)


def rows(v: View, names: str = "_all", condition: str = "", first: int | None = None, last: int | None = None):
    """A preview: slice, then filter, then project; 20 rows without, 200 with a condition alone."""
    check_ranges(v)
    got = v.expand(names)
    df = v.sorted_df()
    if first is not None:
        last = first if last is None else last
        if not 1 <= first <= last or df.limit(last).count() < last:
            raise VerbError(f"in {first}/{last}: no such rows")
        df = df.offset(first - 1).limit(last - first + 1)
    if condition:
        df = df.where(v.condition(condition)[0])
    if first is None:
        df = df.limit(200 if condition else 20)
    return df.select(*[F.col(f"`{n}`") for n in got])


def check_ranges(v: View) -> None:
    for df, first, last in v.ranges:
        if df.limit(last).count() < last:
            raise VerbError(f"in {first}/{last}: there are fewer rows")


def count(v: View, condition: str = "") -> int:
    check_ranges(v)
    return (v.df.where(v.condition(condition)[0]) if condition else v.df).count()


def query(v: View, fragment: str) -> View:
    """Spark SQL after SELECT <variables> FROM the view: where, order by, limit, qualify."""
    name = f"__tabloom_{abs(hash((id(v), fragment)))}"
    v.df.createOrReplaceTempView(name)
    cols = ", ".join(f"`{n}`" for n in v.names)
    low = fragment.strip()
    try:
        if low.lower().startswith("qualify "):
            df = v.df.sparkSession.sql(f"SELECT {cols} FROM (SELECT {cols}, ({low[8:]}) AS __q FROM {name}) WHERE __q")
        else:
            df = v.df.sparkSession.sql(f"SELECT {cols} FROM {name} {fragment}")
    except Exception as e:
        raise VerbError(f"the fragment does not compile: {e}", 920) from e
    return v.then(df, f"query {fragment}")
