"""Writing: versioned tables, the audit report, the graph and its viewer page."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import audit, graph
from foliant.plans.lineage import cut


def _fs(spark: SparkSession, path: str):  # noqa: ANN202 - a JVM file system
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save_versions(tables: dict[str, DataFrame], root: str) -> str:
    """Write ``tables`` as one new version under ``root``, each in a folder of its name ("" for the version's own).

    The version counts once its folder has its final name, so a reader sees whole versions only. Raises if it can't be renamed.
    """
    spark = next(iter(tables.values())).sparkSession
    name = f"{time.time_ns():020d}"
    for part, df in tables.items():
        df.write.parquet(f"{root}/_tmp-{name}/{part}".rstrip("/"))
    fs, p = _fs(spark, f"{root}/_tmp-{name}")
    if not fs.rename(p, _fs(spark, f"{root}/v-{name}")[1]):
        raise OSError(f"the new version could not be renamed to {root}/v-{name}")
    return f"{root}/v-{name}"


def save_version(df: DataFrame, root: str) -> str:
    return save_versions({"": df}, root)


def _latest(spark: SparkSession, root: str) -> str | None:
    fs, p = _fs(spark, root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v-")) if fs.exists(p) else []
    return f"{root}/{names[-1]}" if names else None


def load_version(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The latest version under ``root``; an empty table if there is none, or if none of its files can be opened as a table. A file that
    turns out broken later, as its rows are read, is an error."""
    path = _latest(spark, root)
    try:
        return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def save_graph(nodes: DataFrame, edges: DataFrame, root: str) -> str:
    """Nodes and edges as one version, so that they always belong together."""
    return save_versions({"nodes": nodes, "edges": edges}, root)


def load_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame] | None:
    """Nodes and edges of the latest version, or None if no graph was saved."""
    path = _latest(spark, root)
    if path is None:
        return None
    read = lambda part, schema: spark.read.schema(schema).parquet(f"{path}/{part}")
    return read("nodes", "node_id string, name string, label string, class string, title string"), read("edges", "src string, dst string, label string")


def save_report(issues: DataFrame, path: str) -> bool:
    """Write the audit as JSON with sorted keys; whether it failed."""
    text = audit.report(issues)
    Path(path).write_text(text)
    return json.loads(text)["failed"]


def report_lines(issues: DataFrame, most_terms: int = 20) -> list[str]:
    """The audit as lines for a console: counts by severity, then each issue with its first examples, at most ``most_terms``, and dots if there are more."""
    rows = issues.orderBy("severity", "check").collect()
    head = [f"{s}: {sum(r.severity == s for r in rows)}" for s in ("ERROR", "WARN")]
    shown = lambda r: f": {', '.join(r.examples[:most_terms])}{' ...' * (r.n > len(r.examples[:most_terms]))}" if r.examples else ""
    return head + [f"[{r.severity}] {r.category}: {r.message} ({r.n}){shown(r)}" for r in rows]


_PAGE = """<!doctype html><meta charset="utf-8"><title>Graph</title>
<style>body{font:14px sans-serif;margin:0;display:flex}aside{width:22em;padding:1em;height:100vh;overflow:auto}canvas{flex:1;height:100vh}</style>
<aside><input id="t" placeholder="text"><select id="g"><option></option></select><input id="d" type="number" value="0" min="0"><p id="s"></p><ol id="o"></ol><pre id="a"></pre><ul id="n"></ul></aside><canvas id="c"></canvas>
<script type="application/json" id="p">@@</script>
<script>
const p = JSON.parse(document.getElementById('p').textContent), $ = i => document.getElementById(i), by = new Map(p.nodes.map(n => [n.id, n]));
for (const g of Object.keys(p.summary.groups).sort()) $('g').append(new Option(`${g} (${p.summary.groups[g]})`, g));
$('s').textContent = `${p.summary.nodes} nodes, ${p.summary.edges} edges, ` + Object.entries(p.summary.edgeLabels).map(([k, v]) => `${k} ${v}`).join(', ');
const c = $('c'), x = c.getContext('2d'), span = k => [Math.min(...p.nodes.map(n => n[k])) - 1, Math.max(...p.nodes.map(n => n[k])) + 1];
let hits = p.nodes, chosen = null, place = n => [0, 0], scale = 1;
const around = n => p.edges.filter(e => e.source === n.id || e.target === n.id).map(e => [by.get(e.source === n.id ? e.target : e.source), e.label]).filter(m => m[0]);
function draw() {
  c.width = c.clientWidth; c.height = c.clientHeight;
  const [x0, x1] = span('x'), [y0, y1] = span('y');
  scale = Math.min(c.width / (x1 - x0), c.height / (y1 - y0)); place = n => [(n.x - x0) * scale, (n.y - y0) * scale];
  const on = new Set(hits.map(n => n.id));
  for (const e of p.edges) if (on.has(e.source) && on.has(e.target)) { x.strokeStyle = '#bbb'; x.beginPath(); x.moveTo(...place(by.get(e.source))); x.lineTo(...place(by.get(e.target))); x.stroke(); }
  for (const n of hits) { const [a, b] = place(n); x.fillStyle = n === chosen ? '#d33' : '#36c'; x.beginPath(); x.arc(a, b, 3 + Math.min(9, Math.sqrt(n.degree)), 0, 7); x.fill(); }
}
function pick(n) {
  chosen = n; $('a').textContent = n ? JSON.stringify(n.attrs, null, 1) + (n.pages.length ? `\npages ${n.pages.join(', ')}` : '') : '';
  $('n').replaceChildren(...(n ? around(n).slice(0, 80) : []).map(([m, l]) => Object.assign(document.createElement('li'), {textContent: `${l}: ${m.name}`, onclick: () => pick(m)}))); draw();
}
function show() {
  const text = $('t').value.toLowerCase();
  hits = p.nodes.filter(n => JSON.stringify([n.id, n.name, n.group, n.attrs]).toLowerCase().includes(text) && (!$('g').value || n.group === $('g').value) && n.degree >= +$('d').value);
  $('o').replaceChildren(...[...hits].sort((a, b) => b.degree - a.degree).slice(0, 40).map(n => Object.assign(document.createElement('li'), {textContent: `${n.name} (${n.group}, ${n.degree})`, onclick: () => pick(n)}))); draw();
}
c.onclick = e => { let best = null, least = 16 ** 2; for (const n of hits) { const [a, b] = place(n), d = (a - e.offsetX) ** 2 + (b - e.offsetY) ** 2; if (d <= least) [best, least] = [n, d]; } pick(best); };
for (const i of ['t', 'g', 'd']) $(i).oninput = show;
onresize = draw; show();
</script>
"""


def save_viewer(nodes: DataFrame, edges: DataFrame, path: str, most: int = 5000) -> None:
    """A page of its own with the ``most`` nodes of highest degree and the edges among them, which can be filtered by text, group and degree.

    A page is for looking at: the limit is what a browser shows well, and the page's summary counts the whole graph; the whole payload is
    ``graph.payload``.
    """
    top = cut(graph.top_degree(nodes, edges, most))
    shown = F.broadcast(top.select("node_id"))  # at most ``most`` rows
    places = graph.placed(nodes, edges).join(shown, "node_id")
    some = nodes.join(shown, "node_id")
    ends = edges.join(shown.withColumnRenamed("node_id", "src"), "src", "left_semi").join(shown.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    at, degree = {r.node_id: r for r in places.collect()}, {r.node_id: r.degree for r in top.collect()}
    rows = some.select("node_id", graph.display_name().alias("name"), graph.group_of().alias("group"), graph.attributes().alias("attrs")).collect()
    data = {
        "summary": {
            "nodes": nodes.count(), "edges": edges.count(), "groups": {r["group"]: r.n for r in graph.group_counts(nodes).collect()}, "edgeLabels": {r.label: r.n for r in graph.edge_label_counts(edges).collect()},
        },
        "nodes": [{"id": r.node_id, "name": r.name, "group": r.group, "degree": degree[r.node_id], "x": at[r.node_id].x, "y": at[r.node_id].y, "pages": [], "attrs": json.loads(r.attrs)} for r in rows],
        "edges": [{"source": r.src, "target": r.dst, "label": r.label or "edge"} for r in ends.select("src", "dst", "label").collect()],
    }
    Path(path).write_text(_PAGE.replace("@@", json.dumps(data, sort_keys=True).replace("<", "\\u003c")))


def save_images(images: DataFrame, root: str) -> DataFrame:
    """Add ``images(image_sha256, content)`` to the table of pictures at ``root``, a folder any file system of the cluster holds, unless their
    digest is there; (image_sha256, written). Of contents of one digest the least is kept; null digests and contents are left out."""
    spark = images.sparkSession
    fs, p = _fs(spark, root)
    own = cut(images.select("image_sha256", "content").dropna().groupBy("image_sha256").agg(F.min("content").alias("content")))
    there = spark.read.schema("image_sha256 string").parquet(root) if fs.exists(p) else spark.createDataFrame([], "image_sha256 string")
    known = cut(own.join(there, "image_sha256", "left_semi").select("image_sha256"))
    own.join(known, "image_sha256", "left_anti").write.mode("append").parquet(root)
    return own.select("image_sha256").join(known.withColumn("known", F.lit(True)), "image_sha256", "left").select("image_sha256", F.col("known").isNull().alias("written"))
