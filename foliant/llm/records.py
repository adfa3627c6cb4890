"""Duplicates hidden by formatting: Merkle digests of nested records.

Leaves are normalised and hashed; a node hashes its children's digests, sorted where their order means
nothing; the root digest groups the records, and the whole normalised structure confirms each group.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.plans.lineage import cut
from foliant.plans.skew import attach

#: Groups of copies are broadcast up to this many, counted beforehand; beyond it their members' structures are shuffled to them.
BROADCAST_GROUPS = 200_000


def normal_text(c: Column) -> Column:
    """Letters and digits alone, in one case (lower before upper, so that µ, ß and the Kelvin sign fold too)."""
    return F.upper(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""))


class _Tree:
    """The normal form of a column, and the Merkle digest of such a form."""

    def __init__(self, exact: set[str], delimited: dict[str, str], ordered: set[str]):
        self.exact, self.delimited, self.ordered = exact, delimited, ordered

    def form(self, c: Column, t: T.DataType, path: str) -> Column:
        """``c`` with its leaves normalised, its sets sorted and without repeats; null stays null."""
        if path in self.delimited:
            parts = F.filter(F.transform(F.split(c, self.delimited[path]), normal_text), lambda x: x != "")
            return F.array_sort(F.array_distinct(parts))
        if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
            return c if path in self.exact else normal_text(c)
        if isinstance(t, T.StructType):
            fields = sorted(t.fields, key=lambda f: f.name)
            return F.when(c.isNotNull(), F.struct(*[self.form(c.getField(f.name), f.dataType, f"{path}.{f.name}").alias(f.name) for f in fields]))
        if isinstance(t, T.ArrayType):
            parts = F.transform(c, lambda x: self.form(x, t.elementType, path + "[]"))
            return parts if path in self.ordered else F.array_sort(F.array_distinct(parts))
        if isinstance(t, T.MapType):
            pair = lambda e: F.struct(self.form(e["key"], t.keyType, path + ".key").alias("key"), self.form(e["value"], t.valueType, path + ".value").alias("value"))
            return F.array_sort(F.transform(F.map_entries(c), pair))
        return c

    def digest(self, f: Column, t: T.DataType, path: str) -> Column:
        """The digest of the form ``f`` of a column of type ``t``, from the leaves up."""
        if path in self.delimited:
            out = F.xxhash64(F.lit("set"), F.array_sort(F.transform(f, lambda x: F.xxhash64(F.lit("text"), x))))
        elif isinstance(t, T.StructType):
            fields = sorted(t.fields, key=lambda x: x.name)
            out = F.xxhash64(F.lit("struct"), *[self.digest(f.getField(x.name), x.dataType, f"{path}.{x.name}") for x in fields])
        elif isinstance(t, T.ArrayType):
            parts = F.transform(f, lambda x: self.digest(x, t.elementType, path + "[]"))
            out = F.xxhash64(F.lit("list"), parts) if path in self.ordered else F.xxhash64(F.lit("set"), F.array_sort(parts))
        elif isinstance(t, T.MapType):
            pair = lambda e: F.xxhash64(self.digest(e["key"], t.keyType, path + ".key"), self.digest(e["value"], t.valueType, path + ".value"))
            out = F.xxhash64(F.lit("map"), F.array_sort(F.transform(f, pair)))
        else:
            out = F.xxhash64(F.lit("text" if isinstance(t, T.StringType) else "value"), f)
        return F.when(f.isNull(), F.lit(0).cast("bigint")).otherwise(out)


def digested(df: DataFrame, record_id: str, columns: list[str], exact: set[str] = frozenset(), delimited: dict[str, str] | None = None, ordered: set[str] = frozenset()) -> DataFrame:
    """(record_id, x, y, form): the two halves of each record's Merkle root over ``columns``, and its normal form as JSON. Null ids are left out.

    Leaves are normalised in one projection and hashed in the next, so each is normalised once.
    """
    tree = _Tree(set(exact), dict(delimited or {}), set(ordered))
    types = {c: df.schema[c].dataType for c in columns}
    rows = df.filter(F.col(f"`{record_id}`").isNotNull())
    rows = rows.select(F.col(f"`{record_id}`").alias("record_id"), *[tree.form(F.col(f"`{c}`"), t, c).alias(f"f_{i}") for i, (c, t) in enumerate(types.items())])
    leaves = rows.select("*", *[tree.digest(F.col(f"f_{i}"), t, c).alias(f"d_{i}") for i, (c, t) in enumerate(types.items())])
    children = [F.col(f"d_{i}") for i in range(len(columns))]
    return leaves.select("record_id", F.xxhash64(F.lit(1), *children).alias("x"), F.xxhash64(F.lit(2), *children).alias("y"), F.to_json(F.struct(*[f"f_{i}" for i in range(len(columns))])).alias("form"))


class Collapsed:
    """Groups of equal records among ``rows(record_id, x, y, form)``, as ``digested`` gives them, apart for each value of ``within``.

    Scale: digests and forms are made where a record is read and written once. Only (id, digest) is shuffled, with counts that
    combine before; forms are compared in the groups that have copies, each form of a group once a task. Records meet
    their group by broadcast of the largest groups and an ordinary join of the others, so no group is ever gathered.
    """

    def __init__(self, rows: DataFrame, within: list[str] | None = None):
        self.within = within or []
        self.rows = cut(rows)
        self.keys = [*self.within, "x", "y"]
        if not self._confirmed():  # two structures share a digest: the structure itself belongs to the key
            self.keys.append("form")
            del self.groups

    @cached_property
    def groups(self) -> DataFrame:
        """(within, first_id, copies) and the key of each group."""
        once = self.rows.select(*self.keys, "record_id").distinct()
        return cut(once.groupBy(*self.keys).agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))

    def _confirmed(self) -> bool:
        """Whether all records of each group have the same whole normal form."""
        several = self.groups.filter("copies > 1").select(*self.keys)
        if several.count() <= BROADCAST_GROUPS:
            several = F.broadcast(several)
        forms = self.rows.select(*self.keys, "form").join(several, self.keys, "left_semi").distinct()
        return forms.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()

    def copies(self) -> DataFrame:
        """(within, record_id, first_id, copies) of the records in groups of two and more."""
        members = self.rows.select(*self.keys, "record_id")
        return attach(members, self.groups.filter("copies > 1"), self.keys, "copies").select(*self.within, "record_id", "first_id", "copies").distinct()

    def firsts(self) -> DataFrame:
        """(within, first_id, copies): one row for each group."""
        return self.groups.select(*self.within, "first_id", "copies")

    def records(self) -> DataFrame:
        """(within, record_id, first_id, copies) of every record."""
        single = self.groups.filter("copies = 1").select(*self.within, F.col("first_id").alias("record_id"), "first_id", "copies")
        return self.copies().unionByName(single)


def collapse(df: DataFrame, record_id: str, columns: list[str], **how) -> DataFrame:
    """(record_id, first_id, copies) for every record: the least id of its group and the group's size.

    Records are equal if their ``columns`` are: strings by letters and digits alone in one case, except those
    in ``exact``; numbers by value; arrays as sets, except those in ``ordered``; structs whatever the order of
    their members; strings in ``delimited`` (column → separator pattern) as sets of their parts, empty parts
    left out. Null equals only null; an empty string equals one without letters or digits; an empty array
    differs from null. Columns not named are ignored. A row delivered again (same id and content) counts
    once; one id with two contents belongs to two groups. Rows with a null id and empty tables give no rows.
    """
    return Collapsed(digested(df, record_id, columns, **how)).records()
