"""Extracted entities: cleaning, and flattening into a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import strip
from foliant.plans.skew import union_all

NODES = ["node_id", "name", "label", "class", "title", "page", "has_name"]


def has_content(c: Column, t: T.DataType) -> Column:
    """Whether a value says anything: text that isn't blank, any number or truth value, or a collection or struct with content."""
    if isinstance(t, T.StringType):
        found = strip(c) != ""
    elif isinstance(t, T.ArrayType):
        found = F.exists(c, lambda x: has_content(x, t.elementType))
    elif isinstance(t, T.StructType):
        found = F.lit(False)
        for f in t.fields:
            found = found | has_content(c.getField(f.name), f.dataType)
    elif isinstance(t, T.MapType):
        found = F.exists(F.map_values(c), lambda x: has_content(x, t.valueType))
    else:
        found = c.isNotNull()
    return F.coalesce(found, F.lit(False))


def clean_items(df: DataFrame, column: str) -> Column:
    """The elements of an array of structs that have content; null is an empty array."""
    t = df.schema[column].dataType
    return F.coalesce(F.filter(F.col(column), lambda x: has_content(x, t.elementType)), F.array().cast(t))


def _node(df: DataFrame, node_id: Column, name: Column, label: str, kind: str, title: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(node_id.alias("node_id"), name.alias("name"), F.lit(label).alias("label"), F.lit(kind).alias("class"), (none if title is None else title).alias("title"))


class EntityGraph:
    """nodes(node_id, name, label, class, title) and edges(src, dst, label) of the extracted tables; edges lead from container to part.

    Documents contain registers, pins and timing parameters, registers their bit fields (those with content). An entity delivered
    again is one node; an entity of a null document has no edge. Ids: doc:, reg:, field:, pin: and time: with the entity's key.
    """

    def __init__(self, registry: DataFrame, registers: DataFrame, pins: DataFrame, timing: DataFrame):
        reg = registers.select("reg_id", "doc_id", "name", "address", clean_items(registers, "fields").alias("fields"))
        key = lambda prefix, c: F.concat(F.lit(prefix + ":"), F.col(c).cast("string"))
        docs = union_all([x.select("doc_id") for x in (registry, registers, pins, timing)]).dropna().distinct()
        fields = reg.select("reg_id", F.posexplode("fields").alias("at", "f")).withColumn("key", F.concat(F.lit("field:"), F.col("reg_id").cast("string"), F.lit(":"), F.col("at").cast("string")))
        nodes = [
            _node(docs, key("doc", "doc_id"), F.lit(None).cast("string"), "Document", "DatasheetDocument", F.col("doc_id")),
            _node(reg, key("reg", "reg_id"), F.col("name"), "Register", "Register", F.col("address")),
            _node(fields, F.col("key"), F.col("f.name"), "", "BitField", F.col("f.bit_range")),
            _node(pins, key("pin", "pin_id"), F.lit(None).cast("string"), "Pin", "PinSignal", F.col("pin_name")),
            _node(timing, key("time", "param_id"), F.col("name"), "", "TimingParameter", F.col("symbol")),
        ]
        link = lambda df, src, dst, label: df.select(src.alias("src"), dst.alias("dst"), F.lit(label).cast("string").alias("label")).dropna(subset=["src", "dst"])
        edges = [
            link(registers, key("doc", "doc_id"), key("reg", "reg_id"), "HAS_REGISTER"),
            link(fields, key("reg", "reg_id"), F.col("key"), "HAS_FIELD"),
            link(pins, key("doc", "doc_id"), key("pin", "pin_id"), "HAS_PIN"),
            link(timing, key("doc", "doc_id"), key("time", "param_id"), ""),
        ]
        self.nodes = union_all(nodes).distinct()
        self.edges = union_all(edges).distinct()


def fused(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One graph of several: nodes of one id are merged, each attribute taking its least value that isn't null; edges once each.

    One graph is returned as it is; none is an error.
    """
    if not graphs:
        raise ValueError("no graphs to fuse")
    if len(graphs) == 1:
        return graphs[0]
    nodes = union_all([n for n, _ in graphs])
    merged = nodes.groupBy("node_id").agg(*[F.min(c).alias(c) for c in nodes.columns if c != "node_id"])
    return merged, union_all([e for _, e in graphs]).distinct()
