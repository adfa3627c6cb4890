"""Tools a model may call, and the loop that lets it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from foliant.operators import dense, fusion, graph
from foliant.operators.lexical import LexicalIndex, top_k

MOST_ROUNDS = 6
EXHAUSTED = "No answer was reached within the allowed number of steps."


def _tool(name: str, description: str, required: list[str], optional: tuple[str, ...] = ()) -> dict[str, Any]:
    properties = {k: {"type": "string"} for k in (*required, *optional)}
    return {"type": "function", "function": {"name": name, "description": description, "parameters": {"type": "object", "properties": properties, "required": required}}}


TOOLS = [
    _tool("search_vector", "Find passages by meaning and by words.", ["query"], ("doc_id",)),
    _tool("search_graph", "Find entities whose name contains a text.", ["entity_name"]),
    _tool("get_graph_neighbors", "List the entities linked to one.", ["node_id"]),
]


@dataclass
class Engine:
    """What the tools work on: chunks(seq, chunk_id, doc_id, text, ...), vectors(item, embedding), a graph, and an embedder."""

    chunks: DataFrame
    vectors: DataFrame
    nodes: DataFrame
    edges: DataFrame
    embed: Callable[[list[str]], list[list[float]]]
    _index: LexicalIndex | None = field(default=None, repr=False)

    def search(self, query: str, doc_id: str | None = None, k: int | None = None, mode: str = "hybrid") -> DataFrame:
        """Hits of one query: dense filtered before its ranking, lexical after its cut, fused. ``mode``: hybrid, dense or lexical."""
        spark = self.chunks.sparkSession
        owner = self.chunks.select(F.col("seq").alias("item"), "doc_id").distinct()
        mine = owner.filter(F.col("doc_id") == doc_id) if doc_id else owner
        empty = spark.createDataFrame([], "query_id bigint, item bigint, score double, rank bigint")
        near = words = empty
        if mode != "lexical":
            q = spark.createDataFrame([(0, self.embed([query])[0])], "q bigint, v array<double>")
            near = dense.nearest(self.vectors.join(mine, "item", "left_semi"), "item", "embedding", q, "q", "v")
        if mode != "dense":
            self._index = self._index or LexicalIndex(self.chunks, "seq", "text")
            hits = self._index.search(spark.createDataFrame([(0, query)], "q bigint, t string"), "q", "t")
            words = top_k(hits.drop("rank").join(mine, "item", "left_semi"), 8) if doc_id else hits
        return fusion.final(fusion.reciprocal_rank_fusion(near, words), k)

    def run(self, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
        """A tool's answer as plain data, of the graph all matches; an unknown tool or a missing argument is an error in the answer."""
        tool = next((t["function"] for t in TOOLS if t["function"]["name"] == name), None)
        if tool is None:
            return {"error": f"unknown tool: {name}"}
        missing = [k for k in tool["parameters"]["required"] if not arguments.get(k)]
        if missing:
            return {"error": f"missing argument: {', '.join(missing)}"}
        if name == "search_vector":
            shown = ["chunk_id", "text", "doc_id", "page_start", "page_end", "section_path"]
            once = self.chunks.groupBy("seq").agg(F.min(F.struct(*shown)).alias("c")).select("seq", "c.*")  # of a chunk with several contents the least
            hits = self.search(arguments["query"], arguments.get("doc_id")).join(once, F.col("item") == F.col("seq"))
            rows = hits.orderBy("rank").select("chunk_id", "text", "doc_id", "page_start", "page_end", F.col("section_path").alias("section"))
            return {"results": [r.asDict() for r in rows.collect()]}
        if name == "search_graph":
            found = graph.lookup(self.nodes, arguments["entity_name"]).orderBy("node_id").collect()
            return {"results": [{"node_id": r.node_id, "attrs": _attributes(r)} for r in found]}
        one = self.nodes.filter(F.col("node_id") == arguments["node_id"])
        found = graph.neighbours(self.nodes, self.edges, one).orderBy("node_id", "edge").collect()
        return {"results": [{"node_id": r.node_id, "attrs": _attributes(r), "edge": {"label": r.edge}} for r in found]}


def _attributes(row: Row) -> dict[str, Any]:
    return {k: v for k, v in row.asDict(True).items() if k not in ("node_id", "src", "edge") and v is not None}


@dataclass
class Agent:
    """Asks ``chat(messages, tools) -> message`` until it answers without calling a tool, at most six times."""

    engine: Engine
    chat: Callable[[list[dict[str, Any]], list[dict[str, Any]]], dict[str, Any]]
    system: str = "Answer from the tools' results and name document and page."
    history: list[dict[str, Any]] = field(default_factory=list)

    def ask(self, text: str) -> str:
        self.history.append({"role": "user", "content": text})
        for _ in range(MOST_ROUNDS):
            message = self.chat([{"role": "system", "content": self.system}, *self.history], TOOLS)
            self.history.append(message)
            calls = message.get("tool_calls") or []
            if not calls:
                return message.get("content") or ""
            for call in calls:
                given = call["function"].get("arguments") or {}
                arguments = json.loads(given) if isinstance(given, str) else given
                self.history.append({"role": "tool", "content": json.dumps(self.engine.run(call["function"]["name"], arguments), default=str)})
        return EXHAUSTED

    def reset(self) -> None:
        self.history.clear()


def with_fallback(first: Callable, second: Callable) -> Callable:
    """``first`` until it fails once, from then on ``second``."""
    state = {"now": first}

    def chat(*args: Any, **kw: Any) -> Any:
        if state["now"] is first:
            try:
                return first(*args, **kw)
            except Exception:  # noqa: BLE001 - whatever the model's failure, the other one takes over
                state["now"] = second
        return second(*args, **kw)

    return chat


def missing_models(wanted: list[str], present: list[str]) -> list[str]:
    """The wanted names that no present one equals or begins with."""
    return [w for w in wanted if not any(p.startswith(w) for p in present)]
