"""Property-graph operators over nodes(node_id, name, label, class, title) and edges(src, dst, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import first_text, norm, strip
from foliant.plans.components import components
from foliant.plans.lineage import cut
from foliant.plans.skew import attach, union_all


def label_counts(nodes: DataFrame) -> DataFrame:
    """(label, n): by label, else class, else "unknown"."""
    return nodes.groupBy(F.coalesce(first_text("label", "class"), F.lit("unknown")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def group_of() -> Column:
    """Class, else label, else "Unknown": another precedence than the counts by label have."""
    return F.coalesce(first_text("class", "label"), F.lit("Unknown"))


def display_name() -> Column:
    """The first of name, label and title that isn't blank, stripped, else the id."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in ("name", "label", "title")], F.col("node_id"))


def group_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(group_of().alias("group")).agg(F.count(F.lit(1)).alias("n"))


def edge_label_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.coalesce(first_text("label"), F.lit("edge")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree): edge ends at each node; a loop counts twice, a node without edges 0."""
    ends = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id")))
    return nodes.select("node_id").join(ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("d")), "node_id", "left").select("node_id", F.coalesce("d", F.lit(0)).cast("bigint").alias("degree"))


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, name) of the nodes no edge touches; the name is stripped, else the id."""
    ends = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id")))
    return nodes.join(ends, "node_id", "left_anti").select("node_id", F.coalesce(F.nullif(strip("name"), F.lit("")), F.col("node_id")).alias("name"))


def lookup(nodes: DataFrame, needle: str, named: Column | None = None) -> DataFrame:
    """Nodes whose name contains ``needle`` in any case. ``named`` tells whether a node has the key at all: one without it goes by its
    id, one with a null name by the word "none". Without it, a null name means there is no key. An empty needle finds all."""
    name = F.coalesce(F.col("name"), F.col("node_id") if named is None else F.when(named, F.lit("none")).otherwise(F.col("node_id")))
    return nodes.filter(F.contains(F.lower(name), F.lit(needle.lower())))


def neighbours(nodes: DataFrame, edges: DataFrame, sources: DataFrame, directed: bool = True) -> DataFrame:
    """(src, node_id, name, edge, and the node's other columns): nodes an edge leads to from each of ``sources(node_id)``; both ways unless directed.

    edge is the link's label. Unknown sources give none.
    """
    links = edges if directed else both_ways(edges)
    near = links.join(sources.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi").select("src", "dst", F.coalesce(first_text("label"), F.lit("edge")).alias("edge"))
    rest = [c for c in nodes.columns if c not in ("node_id", "name")]
    return near.join(nodes.withColumnRenamed("node_id", "dst"), "dst").select("src", F.col("dst").alias("node_id"), "name", "edge", *rest)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "label").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label"))


def adjacency(edges: DataFrame, first: int = 80) -> DataFrame:
    """(src, dst, label, nth): up to ``first`` links of each node, both ways, loops twice; the cut is made before the shuffle too."""
    w = Window.partitionBy("src").orderBy("dst", "label")
    return both_ways(edges).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= first).withColumn("nth", F.col("nth").cast("bigint"))


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size): weakly connected components, named by their least node id."""
    c = components(nodes.select(F.col("node_id").alias("vertex")), edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def grid(sizes: DataFrame, cell: float = 2.8) -> DataFrame:
    """(component, size, x, y): components by falling size on a square grid, row by row.

    The place of a component is the number of larger ones: sizes are counted first, so the only ordered window is over distinct
    sizes, and components of one size are numbered within blocks.
    """
    from foliant.plans.ordered import numbered

    sizes = cut(sizes)
    n = sizes.count()
    columns = max(1, int(-(-(n**0.5) // 1)))
    by_size = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("k")).withColumn("one", F.lit(1))
    w = Window.partitionBy("one").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    start = by_size.select("size", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("start"))
    ranked = numbered(sizes.withColumn("h", F.xxhash64("component")), ["size"], "h", "nth", 2**58)
    placed = ranked.join(start, "size").withColumn("at", F.col("start") + F.col("nth"))
    return placed.select("component", "size", F.pmod("at", F.lit(columns)).alias("col"), F.floor(F.col("at") / columns).alias("row")).select("component", "size", (F.col("col") * cell).alias("x"), (F.col("row") * cell).alias("y"))


def top_degree(nodes: DataFrame, edges: DataFrame, k: int = 40) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "node_id").limit(k)


def attributes() -> Column:
    """A node's own columns as a JSON object, without nulls."""
    return F.to_json(F.struct("class", "label", "name", "title"))


def viewer_filter(nodes: DataFrame, edges: DataFrame, text: str = "", group: str = "", least_degree: int = 0) -> DataFrame:
    """(node_id, name, group, degree) of nodes of at least a degree whose id, name, group and attributes, as JSON, contain ``text`` in any
    case, in ``group`` if one is named."""
    n = nodes.join(degrees(nodes, edges), "node_id").select("node_id", display_name().alias("shown"), group_of().alias("group"), "degree", attributes().alias("attrs"))
    said = F.lower(F.concat_ws(",", F.to_json(F.array("node_id", "shown", "group")), "attrs"))
    out = n.filter(F.contains(said, F.lit(text.lower())) & (F.col("degree") >= least_degree))
    return (out.filter(F.col("group") == group) if group else out).select("node_id", F.col("shown").alias("name"), "group", "degree")


def pages(c: Column) -> Column:
    """Whole numbers of an array of texts, each once, in order; anything else is left out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x.cast("string")).try_cast("int")), lambda x: x.isNotNull())))


def payload(nodes: DataFrame, edges: DataFrame, page_numbers: DataFrame | None = None) -> DataFrame:
    """(part, key, json): the viewer's nodes and edges as one JSON object each, and how many nodes each group and edges each label has.

    A node has its id, name, group, degree, attributes and pages: those of ``page_numbers(node_id, pages array<string>)`` that are whole
    numbers, each once, in order. Where it is placed is ``placed``'s.
    """
    n = nodes.join(degrees(nodes, edges), "node_id")
    n = n.join(page_numbers.select("node_id", pages(F.col("pages")).alias("pages")), "node_id", "left") if page_numbers is not None else n.withColumn("pages", F.lit(None).cast("array<int>"))
    fields = F.struct("class", "label", "name", "title").alias("attrs")
    as_node = F.to_json(F.struct(F.col("node_id").alias("id"), display_name().alias("name"), group_of().alias("group"), "degree", F.coalesce("pages", F.array().cast("array<int>")).alias("pages"), fields))
    as_edge = F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.coalesce(first_text("label"), F.lit("edge")).alias("label")))
    counted = lambda part, d, c: d.select(F.lit(part).alias("part"), F.col(c).alias("key"), F.col("n").cast("string").alias("json"))
    parts = [
        n.select(F.lit("node").alias("part"), F.col("node_id").alias("key"), as_node.alias("json")),
        edges.select(F.lit("edge").alias("part"), F.concat_ws(" ", "src", "dst").alias("key"), as_edge.alias("json")),
        counted("group", group_counts(nodes), "group"),
        counted("edge_label", edge_label_counts(edges), "label"),
    ]
    return union_all(parts)


def placed(nodes: DataFrame, edges: DataFrame, cell: float = 2.8) -> DataFrame:
    """(node_id, x, y): components on a grid by falling size, the nodes of each around its place, at an angle and a distance by a hash of the id."""
    c = components(nodes.select(F.col("node_id").alias("vertex")), edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    c = cut(c)
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    at = attach(c, grid(sizes, cell), ["component"], "size")
    angle = F.pmod(F.xxhash64("vertex"), F.lit(36_000)) * (3.141592653589793 / 18_000)
    radius = F.when(F.col("size") > 1, F.sqrt(F.pmod(F.xxhash64("vertex", F.lit(1)), F.lit(10_000)) / 10_000) * (0.45 * cell)).otherwise(0.0)
    return at.select(F.col("vertex").alias("node_id"), F.round(F.col("x") + radius * F.cos(angle), 4).alias("x"), F.round(F.col("y") + radius * F.sin(angle), 4).alias("y"))


def term_hits(nodes: DataFrame, edges: DataFrame, terms: list[str]) -> DataFrame:
    """(term, hits, max_degree): nodes whose name contains each term, and the highest degree among them (0 without any).

    Terms are a short list given by the caller: each node row names the terms it contains, so there is no join with them.
    """
    spark = nodes.sparkSession
    name = F.lower(F.coalesce("name", "node_id"))
    given = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(name, F.lower(t)))
    hits = nodes.select("node_id", F.explode(given).alias("term")).join(degrees(nodes, edges), "node_id").groupBy("term").agg(F.count(F.lit(1)).alias("hits"), F.max("degree").alias("max_degree"))
    all_terms = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    return all_terms.join(hits, "term", "left").select("term", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"), F.coalesce("max_degree", F.lit(0)).cast("bigint").alias("max_degree"))


def graph_terms(nodes: DataFrame, most: int = 40) -> DataFrame:
    """(term, node_id): the first ``most`` names in node order, of 2 to 80 characters, one spelling (the first) of each."""
    t = nodes.select(strip("name").alias("term"), "node_id").filter("length(term) BETWEEN 2 AND 80")
    once = t.groupBy(norm("term").alias("key")).agg(F.min(F.struct("node_id", "term")).alias("f"))
    return once.select("f.term", "f.node_id").orderBy("node_id").limit(most)


def hit_test(places: DataFrame, x: float, y: float, scale: float = 1.0) -> DataFrame:
    """The node of ``places(node_id, x, y)`` nearest to a point, if it lies within 16 / scale; ties by id."""
    d = F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2)
    best = places.withColumn("d", d).filter(F.col("d") <= (16 / scale) ** 2).agg(F.min(F.struct("d", "node_id")).alias("m"))
    return best.filter("m IS NOT NULL").select("m.node_id")
