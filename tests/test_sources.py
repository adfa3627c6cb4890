import json

import pytest
from pyspark.sql import functions as F

from foliant import cli
from foliant.operators.embedding import embedded
from foliant.operators.tools import EXHAUSTED, TOOLS, Agent, Engine, missing_models, with_fallback
from foliant.sources import build, layout, registry, sinks
from foliant.streaming.ingest import ChunkStore, start
from tests.conftest import rows


def test_html_items():
    page = b"<h1>A &amp; b</h1><script>x='</p>'</script><p>one <b>two</b><p>three<ul><li>four</ul><table><tr><td>c<td>d</table><img alt='pic'><!-- <p>no</p> -->"
    got = layout.parse_html(page)
    assert [k for k, _, _ in got] == ["header", "text", "text", "text", "table", "picture"]
    assert [t for _, _, t in got][:4] == ["A & b", "one two", "three", "four"]


def test_parsed_and_existing(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.html").write_text("<p>x</p>")
    reg = spark.createDataFrame([("a", "raw//a.HTML", 1), ("a", "raw/old.txt", 0), ("b", "raw/none.html", 1), ("c", None, 1), ("d", " ", 1)], "doc_id string, path string, registered_at int")
    assert rows(registry.registered(reg)) == [("a", "raw/a.html"), ("b", "raw/none.html")]
    found = registry.existing(spark, reg, str(tmp_path))
    assert rows(found, "doc_id") == [("a",)]
    assert rows(layout.parsed(found), "doc_id", "kind", "text") == [("a", "text", "x")]
    assert layout.parsed(found, {"html": lambda c: [("header", 2, "own")]}).first().text == "own"


def test_text_items(spark):
    df = spark.createDataFrame([(1, "OM900-12\nBody\n\nREG = 0x1;"), (2, None), (3, "")], "id int, t string")
    assert rows(layout.text_items(df, "id", "t"), "seq", "kind", "page_no") == [(1, "header", 1), (2, "text", 1), (4, "table", 1)]


def test_versions(spark, tmp_path):
    root = f"{tmp_path}/cache"
    assert sinks.load_version(spark, root, "x int").count() == 0
    for n in (1, 2):
        sinks.save_version(spark.range(n).select(F.col("id").cast("int").alias("x")), root)
    assert sinks.load_version(spark, root, "x int").count() == 2
    newest = sorted((tmp_path / "cache").glob("v-*"))[-1]
    for f in newest.glob("*.parquet"):
        f.write_bytes(b"broken")
    assert isinstance(sinks.load_version(spark, root, "x int").columns, list)


def test_graph_files_and_page(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "</script>", "L", "C", None)], "node_id string, name string, label string, class string, title string")
    edges = spark.createDataFrame([("a", "a", "x")], "src string, dst string, label string")
    assert sinks.load_graph(spark, f"{tmp_path}/g") is None
    sinks.save_graph(nodes, edges, f"{tmp_path}/g")
    n, e = sinks.load_graph(spark, f"{tmp_path}/g")
    assert n.count() == 1 and e.count() == 1
    sinks.save_viewer(n, e, f"{tmp_path}/p.html")
    assert (tmp_path / "p.html").read_text().count("</script>") == 2


def test_saved_images(spark, tmp_path):
    df = spark.createDataFrame([("s1", bytearray(b"x")), ("s1", bytearray(b"x")), (None, bytearray(b"y"))], "image_sha256 string, content binary")
    assert rows(sinks.save_images(df, str(tmp_path))) == [("s1", True)]
    assert rows(sinks.save_images(df, str(tmp_path))) == [("s1", False)]


CHUNK = "chunk_id string, seq bigint, ingested_at int, text string"


def test_streamed_ingest(spark, tmp_path):
    source, store = f"{tmp_path}/in", ChunkStore(f"{tmp_path}/store")
    put = lambda *d: spark.createDataFrame(list(d), CHUNK).coalesce(1).write.mode("append").parquet(source)
    put(("a", 1, 1, "old"), ("b", 2, 1, "b"), (None, 3, 1, "no"))
    start(spark, source, CHUNK, store, f"{tmp_path}/state").awaitTermination()
    put(("a", 1, 2, "new"), ("b", 2, 1, "b"))
    start(spark, source, CHUNK, store, f"{tmp_path}/state").awaitTermination()
    assert rows(store.current(spark), "chunk_id", "text") == [("a", "new"), ("b", "b")]
    store.add(spark.createDataFrame([("a", 1, 2, "new"), ("b", 2, 1, "b")], CHUNK), 1)  # a batch that is run again
    assert store.log(spark).count() == 4
    assert rows(store.compacted(spark, f"{tmp_path}/new").current(spark), "chunk_id", "text") == [("a", "new"), ("b", "b")]


def test_embedded(spark):
    def model(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, None)], "id int, t string").coalesce(1)
    assert {r["item"]: r.embedding for r in embedded(df, "id", "t", model).collect()} == {1: [3.0], 2: None, 3: [0.0]}


def engine(spark):
    chunks = spark.createDataFrame([(i, f"c{i}", "d" if i % 2 else "e", f"word{i} common", 1, 1, "s") for i in range(6)], "seq bigint, chunk_id string, doc_id string, text string, page_start int, page_end int, section_path string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "item bigint, embedding array<float>")
    nodes = spark.createDataFrame([("n1", "Watchdog", "L", "C", None), ("n2", "Timer", "L", "C", None)], "node_id string, name string, label string, class string, title string")
    edges = spark.createDataFrame([("n1", "n2", "x")], "src string, dst string, label string")
    return Engine(chunks, vectors, nodes, edges, lambda texts: [[1.0, 0.0] for _ in texts])


def test_tools(spark):
    e = engine(spark)
    hits = e.run("search_vector", {"query": "word3", "doc_id": "d"})["results"]
    assert {h["doc_id"] for h in hits} == {"d"} and "score" not in hits[0]
    assert e.search("word3", mode="lexical").count() == 1 and e.search("word3", mode="dense", k=2).count() == 2
    assert [r["node_id"] for r in e.run("search_graph", {"entity_name": "watch"})["results"]] == ["n1"]
    assert e.run("get_graph_neighbors", {"node_id": "n1"})["results"] == [{"node_id": "n2", "attrs": {"name": "Timer", "label": "L", "class": "C"}, "edge": {"label": "x"}}]
    assert e.run("get_graph_neighbors", {"node_id": "n2"})["results"] == []
    assert "error" in e.run("search_graph", {}) and "error" in e.run("nothing", {})


def test_graph_tools_return_all(spark):
    e = engine(spark)
    e.nodes = spark.createDataFrame([(f"n{i}", f"pin {i}", "L", "C", None) for i in range(120)], e.nodes.schema)
    e.edges = spark.createDataFrame([("n0", f"n{i}", "x") for i in range(1, 120)], e.edges.schema)
    assert len(e.run("search_graph", {"entity_name": "pin"})["results"]) == 120
    assert len(e.run("get_graph_neighbors", {"node_id": "n0"})["results"]) == 119


def test_agent(spark):
    turns = iter([{"role": "assistant", "tool_calls": [{"function": {"name": "search_graph", "arguments": '{"entity_name": "timer"}'}}]}, {"role": "assistant", "content": "done"}])
    agent = Agent(engine(spark), lambda messages, tools: next(turns))
    assert agent.ask("?") == "done" and json.loads(agent.history[2]["content"])["results"][0]["node_id"] == "n2"
    agent.reset()
    assert agent.history == [] and len(TOOLS) == 3
    endless = Agent(agent.engine, lambda m, t: {"role": "assistant", "tool_calls": [{"function": {"name": "x", "arguments": {}}}]})
    assert endless.ask("?") == EXHAUSTED


def test_fallback_sticks():
    calls = []

    def first():
        calls.append(1)
        raise RuntimeError

    chat = with_fallback(first, lambda: "second")
    assert [chat(), chat()] == ["second", "second"] and calls == [1]
    assert missing_models(["a", "b:1"], ["a-large", "c"]) == ["b:1"]


def test_command_line(spark, folder, tmp_path, monkeypatch, capsys):
    assert cli.main(["audit", folder, "--json", f"{tmp_path}/r.json"]) == 1 and json.loads((tmp_path / "r.json").read_text())["failed"]
    assert cli.main(["graph", folder, "--output", f"{tmp_path}/g", "--page", f"{tmp_path}/p.html"]) == 0
    monkeypatch.setattr("sys.stdin", iter(["\n", "watchdog timer\n", "exit\n"]))
    assert cli.main(["search", folder, "--top-k", "2"]) == 0 and len(capsys.readouterr().out.split("\n")) >= 3
    with pytest.raises(SystemExit):
        cli.main([])


def test_ingest_and_reparse(spark, folder, tmp_path, capsys):
    """Files to chunks to an audit that compares them with the stored ones."""
    (tmp_path / "raw").mkdir()
    paths = {r.doc_id: r.path for r in registry.registered(spark.read.parquet(f"{folder}/registry.parquet")).collect()}
    doc, path = sorted(paths.items())[0]
    target = tmp_path / "raw" / path
    target.parent.mkdir(parents=True, exist_ok=True)
    reg = spark.createDataFrame([(doc, "a.html", 1)], "doc_id string, path string, registered_at int")
    (tmp_path / "raw" / "a.html").write_text("<h1>Top</h1><p>one</p><p>two</p><table><tr><td>a<td>b</table><img alt='a picture'><p>three</p>")
    got = build.build(spark, reg, f"{tmp_path}/raw")
    assert rows(got, "chunk_type", "text", "section_path") == sorted([("atomic_table", "| a | b", "Top"), ("image_analysis", "a picture", "Top"), ("structural", "one two", "Top"), ("structural", "three", "Top")], key=repr)
    assert got.select("chunk_id").distinct().count() == 4 and build.build(spark, reg, f"{tmp_path}/raw", skip_images=True).count() == 3
    out = f"{tmp_path}/chunks"
    assert cli.main(["ingest", folder, "--files", f"{tmp_path}/raw", "--output", out, "--image-cache-only"]) == 0
    assert sinks.load_version(spark, out, "chunk_type string").filter("chunk_type = 'image_analysis'").count() > 0
    assert cli.main(["audit", folder, "--files", f"{tmp_path}/raw", "--skip-reparse", "--terms", "watchdog", "--max-graph-terms", "3"]) == 1
    assert "not checked" in capsys.readouterr().out


def answer(messages, tools):
    return {"role": "assistant", "content": f"{len(messages)} messages"}


def vectors(texts):
    return [[1.0] * 64 for _ in texts]


def test_ask(spark, folder, monkeypatch, capsys):
    monkeypatch.setattr("sys.stdin", iter(["\n", "what?\n", "and?\n", "reset\n", "again?\n", "exit\n", "no\n"]))
    assert cli.main(["ask", folder, "--chat", "tests.test_sources:answer", "--embed", "tests.test_sources:vectors"]) == 0
    assert [x for x in capsys.readouterr().out.split("\n") if "messages" in x] == ["2 messages", "4 messages", "2 messages"]


def test_graph_version_is_whole(spark, tmp_path):
    n = lambda k: spark.createDataFrame([(str(i), None, None, None, None) for i in range(k)], "node_id string, name string, label string, class string, title string")
    e = lambda k: spark.createDataFrame([("0", "0", "x")] * k, "src string, dst string, label string")
    sinks.save_graph(n(2), e(1), f"{tmp_path}/g")
    n(3).write.parquet(f"{tmp_path}/g/_tmp-later/nodes")  # a version that isn't finished
    found = sinks.load_graph(spark, f"{tmp_path}/g")
    assert [d.count() for d in found] == [2, 1]
