"""Turning text into vectors through a model of the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A list of texts to a list of vectors.
Embedder = Callable[[list[str]], list[list[float]]]


def embedded(df: DataFrame, item: str, text: str, embedder: Embedder, batch: int = 32) -> DataFrame:
    """(item, embedding) by ``embedder``, in batches; where a batch fails, its texts are tried one by one, and a text that fails alone has a null vector."""

    def one(t: str) -> list[float] | None:
        try:
            return embedder([t])[0]
        except Exception:  # noqa: BLE001 - a model's failure on one text must not lose the others
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors: list[list[float] | None] = []
            for at in range(0, len(b), batch):
                part = b.text.iloc[at : at + batch].tolist()
                try:
                    vectors += embedder(part)
                except Exception:  # noqa: BLE001
                    vectors += [one(t) for t in part]
            yield pd.DataFrame({"item": b["item"], "embedding": vectors})

    rows = df.select(F.col(f"`{item}`").alias("item"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"item {rows.schema['item'].dataType.simpleString()}, embedding array<float>")
