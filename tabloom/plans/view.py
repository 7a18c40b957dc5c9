"""The lazy view: an immutable plan of a DataFrame, its columns' metadata, and a deferred sort.

A verb returns a new View, or raises VerbError and leaves this one as it was.
Nothing runs until a materialiser, a statistic or a verb that must check the data
(merge, reshape, a slice) asks for it.
"""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import VerbError, not_found
from ..functions.expression import Value, parse
from ..functions.values import key_of


@dataclass(frozen=True)
class Meta:
    """What a column carries besides its values."""

    storage: str = ""
    fmt: str = ""
    label: str = ""
    value_label: str = ""
    source: str = ""
    chars: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class View:
    df: DataFrame
    meta: dict[str, Meta] = field(default_factory=dict)
    order: tuple[tuple[str, bool], ...] = ()  # (column, descending); hidden columns "__o..." may be among them
    ranges: tuple[tuple[DataFrame, int, int], ...] = ()
    value_labels: dict[str, dict[int, str]] = field(default_factory=dict)
    data_label: str = ""
    missing_high: bool = False
    steps: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    notes: tuple[str, ...] = ()
    source: DataFrame | None = None  # as it was read, for what loading must tell of it
    in_order: tuple[DataFrame, tuple[tuple[str, bool], ...], DataFrame] | None = None  # a df, an order, and that df's rows as they come in that order without a sort

    # -- what there is

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__o")]

    @property
    def kinds(self) -> dict[str, str]:
        return {f.name: "s" if isinstance(f.dataType, T.StringType) else "n" for f in self.df.schema if not f.name.startswith("__o")}

    def type_of(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def is_float(self, name: str) -> bool:
        return isinstance(self.type_of(name), (T.FloatType, T.DoubleType))

    def expand(self, text: str | list[str], wild: bool = True) -> list[str]:
        """Names of a list such as "id wage*", in the order they are named, each once."""
        out: list[str] = []
        for word in text.split() if isinstance(text, str) else text:
            if wild and any(c in word for c in "*?"):
                got = [n for n in self.names if fnmatch.fnmatchcase(n, word.replace("[", "[[]"))]
            elif word == "_all":
                got = self.names
            else:
                got = [n for n in self.names if n == word]
            if not got:
                raise not_found(word)
            out += [n for n in got if n not in out]
        if not out:
            raise VerbError("no variables are named")
        return out

    def key(self, name: str) -> Column:
        return key_of(name, self.type_of(name))

    def value(self, text: str, rows: bool = False) -> tuple[Value, set[str]]:
        v, p = parse(text, self.kinds, self.missing_high, rows)
        return v, p.uses

    def condition(self, text: str, rows: bool = False) -> tuple[Column, set[str]]:
        v, p = parse(text, self.kinds, self.missing_high, rows)
        return p.truth(v), p.uses

    def orders(self) -> list[Column]:
        return [F.col(f"`{n}`").desc_nulls_last() if down else F.col(f"`{n}`").asc_nulls_last() for n, down in self.order]

    def total_order(self) -> list[Column]:
        """The declared order; without one, all columns, so that what comes first is the same on every run."""
        return self.orders() or [F.col(f"`{n}`").asc_nulls_last() for n in self.names]

    def rank_keys(self) -> list[Column]:
        """Columns whose ascending order, one after another, is the total order."""
        out = []
        for n, down in self.order or [(n, False) for n in self.names]:
            c = F.col(f"`{n}`")
            out += [c.isNull(), (descending(c, isinstance(self.type_of(n), T.StringType)) if down else c)]
        return out

    def sorted_df(self) -> DataFrame:
        if self.in_order and self.in_order[0] is self.df and self.in_order[1] == self.order:
            df = self.in_order[2]
        else:
            df = self.df.orderBy(*self.orders()) if self.order else self.df
        return df.select(*[F.col(f"`{n}`") for n in self.names])

    # -- steps

    def then(self, df: DataFrame, step: str, **changes) -> View:
        meta = changes.pop("meta", self.meta)
        cols = set(df.columns)
        order = changes.pop("order", self.order)
        kept = []
        for n, down in order:
            if n not in cols:
                break
            kept.append((n, down))
        return replace(self, df=df, meta={k: v for k, v in meta.items() if k in cols}, order=tuple(kept), steps=(*self.steps, step), **changes)

    def baked(self, name: str) -> tuple[DataFrame, tuple[tuple[str, bool], ...]]:
        """Before a sort key is dropped or overwritten: its values live on in a hidden column that sorts in its place."""
        if name not in [n for n, _ in self.order]:
            return self.df, self.order
        hidden = f"__o{len(self.df.columns)}_{name}"
        return self.df.withColumn(hidden, F.col(f"`{name}`")), tuple((hidden if n == name else n, d) for n, d in self.order)

    def with_rows(self, uses: set[str]) -> DataFrame:
        """The rows with their number (__row_n) and how many there are (__rows), if used."""
        df = self.df
        if "_N" in uses:
            df = df.withColumn("__rows", F.lit(df.count()))
        if "_n" in uses:
            df = numbered(df, self.rank_keys(), "__row_n")
        return df

    def plain(self, df: DataFrame) -> DataFrame:
        return df.drop("__row_n", "__rows")


def descending(c: Column, string: bool) -> Column:
    """A column whose ascending order is the descending one of c: of a string, its bytes turned about (a longer one first)."""
    if not string:
        return -c
    return F.concat(F.translate(F.hex(F.encode(c, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


#: Sampled keys a partition from which the bounds of ranges are taken.
SAMPLED = 32


def ranges(df: DataFrame, keys: list[Column]) -> tuple[Column, Column, dict[int, int]]:
    """A key of the rows, the number of the range it lies in, and the rows of each range.

    The bounds come from a sample by a hash of the key, so they are the same on every
    run and nothing has to be kept; a range is found by a binary search over the bounds.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    slim = df.select(key.alias("k"))
    share = min(1.0, SAMPLED * n / max(1, df.count()))
    drawn = slim.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else slim
    told = drawn.distinct().orderBy("k").collect()  # SAMPLED keys a partition
    kinds = [f.dataType for f in slim.schema["k"].dataType]
    step = max(1, -(-len(told) // n))
    bounds = [F.struct(*[F.lit(x).cast(t).alias(f"k{i}") for i, (x, t) in enumerate(zip(r["k"], kinds, strict=True))]) for r in told[step::step]]

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < bounds[middle], within(low, middle)).otherwise(within(middle + 1, high))

    place = within(0, len(bounds)).cast("int")
    return key, place, {r["p"]: r["n"] for r in df.select(place.alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}


def numbered(df: DataFrame, keys: list[Column], name: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """df with the row number in the ascending order of keys; of rows first to last alone, if given.

    Rows are dealt to ranges of the keys and numbered within them, after the counts of
    the ranges before, so no task holds all rows, and ranges outside first to last are not
    dealt at all.  Of rows with equal keys the order is that of a hash of the whole row.
    """
    key, place, counts = ranges(df, keys)
    before, at = {}, 0
    for p in sorted(counts):
        before[p] = at
        at += counts[p]
    if not before:
        return df.withColumn(name, F.lit(0).cast("long"))
    offset = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])
    dealt = df.withColumn("__place", place)
    if first is not None:
        dealt = dealt.where(F.col("__place").isin([p for p in before if before[p] < last and before[p] + counts[p] >= first]))
    w = Window.partitionBy("__place").orderBy(key, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    out = dealt.withColumn(name, F.row_number().over(w) + F.element_at(offset, F.col("__place").cast("long"))).drop("__place")
    return out if first is None else out.where(F.col(name).between(first, last))
