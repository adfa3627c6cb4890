"""Mixing sources to target weights: token counts, domain posteriors, and rates by projected-gradient least squares."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.lineage import cut

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
OTHER = "(other)"
#: Steps of the uniform number that decides the last, partial repetition of a source.
BINS = 65_536


@lru_cache(1)
def tokenizer(path: str):
    """The public byte-level tokenizer whose ranks lie at ``path``."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@dataclass
class DomainClassifier:
    """Naive Bayes over token numbers; the temperature is fitted on held-out labelled texts, so that posteriors are honest."""

    log_prior: np.ndarray
    log_token: np.ndarray
    temperature: float = 1.0

    def posterior(self, ids: list[int]) -> np.ndarray:
        x = self.log_token[:, ids].sum(1) / self.temperature + self.log_prior
        x = np.exp(x - x.max())
        return x / x.sum()

    @staticmethod
    def fit(sample: list[tuple[int, list[int]]], prior: np.ndarray, size: int) -> DomainClassifier:
        train, held = [s for i, s in enumerate(sample) if i % 5], sample[::5]
        counts = np.zeros((len(prior), size), dtype=np.float32)
        for domain, ids in train:
            np.add.at(counts[domain], ids, 1)
        every = counts.sum(0) + 0.01
        own = counts + 1000 * every / every.sum()
        model = DomainClassifier(np.log(prior), np.log(own / own.sum(1, keepdims=True)).astype(np.float32))
        best = (-np.inf, 1.0)
        for t in (1, 2, 4, 8, 16, 32, 64, 128, 256, 1024):
            model.temperature = float(t)
            fit = sum(np.log(model.posterior(ids)[domain] + 1e-12) for domain, ids in held if ids)
            best = max(best, (fit, float(t)))
        model.temperature = best[1]
        return model


def largest_total(totals: np.ndarray, weight: np.ndarray, scarce: float) -> float:
    """The least of the totals that single sources allow, without those below ``scarce`` times the weighted median one."""
    order = np.argsort(totals)
    median = totals[order][np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)]
    return float(totals[totals >= scarce * median].min())


class Mixture:
    """A selection of documents in which each listed source has its target share of the tokens.

    ``targets(source, weight, max_repeats)``: rows without a source or with a weight of zero or less are left
    out, a source listed twice has the sum of its weights and the lesser cap, and weights are scaled to 1.
    A document of a listed source belongs to it; one without a source belongs to each domain (listed sources and
    the rest) with the posterior of a classifier fitted on at most ``per_source`` labelled texts of at most ``longest`` characters a domain (every
    document is counted and selected, however long); documents of
    other sources are never used. Rates, between 0 and the cap of the (likeliest) source, minimise the squared
    gap between each domain's expected tokens and its target; the rest's target is 0. Without ``total`` the target
    total is the largest at which no source needs more than its cap, but for scarce ones: those whose text at the cap would hold the total
    below ``scarce`` times the total of the (weighted) median source. These don't bind it; they are used at their cap and their shortfall is
    reported. A source without text gets nothing. The others keep their proportions. A larger ``total`` leaves scarce sources at their caps, short of
    their share, as the report then says. Null texts and empty ones have no tokens; a null id is left out; a document given twice counts once.

    Scale: texts are tokenized where they are read and only (id, source, tokens, posterior) is kept; each gradient
    step is one aggregate over distinct membership vectors; per-source numbers alone reach the driver.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, per_source: int = 200, longest: int = 20_000, rounds: int = 60, ranks: str = RANKS, seed: int = 7, scarce: float = 0.05):
        wanted = targets.filter("source IS NOT NULL AND weight > 0 AND max_repeats > 0").groupBy("source").agg(F.sum("weight").alias("w"), F.min("max_repeats").alias("cap")).orderBy("source").collect()
        self.sources = [r.source for r in wanted]
        self.weight = np.array([r.w for r in wanted], dtype=float)
        self.weight /= max(self.weight.sum(), 1e-300)
        self.cap = np.array([r.cap for r in wanted], dtype=int)
        self.spark = docs.sparkSession
        self.seed, self.ranks = seed, ranks
        base = docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
        self.members = cut(self._members(base, per_source, longest))
        sums = {r.source: (r.n, r.t, r.m) for r in self.members.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.max("tokens").alias("m")).collect()}
        self.documents = np.array([sums.get(s, (0, 0, 0))[0] for s in self.sources])
        self.tokens = np.array([sums.get(s, (0, 0, 0))[1] for s in self.sources], dtype=float)
        self.longest = np.array([sums.get(s, (0, 0, 0))[2] for s in self.sources], dtype=float)
        have = self.tokens > 0
        most = largest_total(self.cap[have] * self.tokens[have] / self.weight[have], self.weight[have], scarce) if have.any() else 0.0
        self.total = most if total is None else float(total)
        self.history = self._fit_rates(rounds)

    def _members(self, base: DataFrame, per_source: int, longest: int) -> DataFrame:
        """(doc_id, source, tokens, p): p is null where the source is known."""
        listed = base.filter(F.col("source").isNull() | F.col("source").isin(self.sources))
        model = self._classifier(base, per_source, longest) if self.sources and not base.filter("source IS NULL").isEmpty() else None
        shared, ranks = self.spark.sparkContext.broadcast(model), self.ranks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, enc = shared.value, tokenizer(ranks)
            for b in batches:
                tokens, p = [], []
                for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    ids = enc.encode_ordinary(t)
                    tokens.append(len(ids))
                    p.append(None if s is not None or m is None else m.posterior(ids).round(4).tolist())
                yield pa.record_batch([b.column(0), b.column(1), pa.array(tokens, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=["doc_id", "source", "tokens", "p"])

        counted = listed.mapInArrow(run, "doc_id bigint, source string, tokens bigint, p array<double>")
        return counted.filter("source IS NOT NULL OR p IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct("source", "tokens", "p"), F.struct(F.coalesce("source", F.lit("")), "tokens")).alias("r")).select("doc_id", "r.*")

    def _classifier(self, base: DataFrame, per_source: int, longest: int) -> DomainClassifier | None:
        known = base.filter("source IS NOT NULL").withColumn("domain", F.when(F.col("source").isin(self.sources), F.col("source")).otherwise(F.lit(OTHER)))
        sizes = {r.domain: r.n for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not sizes:
            return None
        order = Window.partitionBy("domain").orderBy(F.xxhash64("doc_id"), "doc_id")
        rows = known.filter(F.length("text") <= longest).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_source).select("domain", "text", "doc_id").orderBy("doc_id").collect()
        names = [*self.sources, OTHER]
        enc = tokenizer(self.ranks)
        prior = np.array([sizes.get(s, 0) for s in names], dtype=float) + 1e-6
        return DomainClassifier.fit([(names.index(r.domain), enc.encode_ordinary(r.text)) for r in rows], prior / prior.sum(), enc.n_vocab)

    # rates

    def _membership(self) -> tuple[Column, Column]:
        """Each document's vector over the listed sources and the rest, and its cap."""
        n = len(self.sources)
        one_hot = F.create_map(*[x for i, s in enumerate(self.sources) for x in (F.lit(s), F.array(*[F.lit(float(i == j)) for j in range(n + 1)]))])
        p = F.when(F.col("source").isNotNull(), one_hot[F.col("source")]).otherwise(F.col("p"))
        caps = F.array(*[F.lit(int(c)) for c in self.cap])
        listed = F.slice(p, 1, n)
        return p, F.element_at(caps, F.array_position(listed, F.array_max(listed)).cast("int")).cast("double")

    def _rate(self, p: Column, cap: Column, history: list[np.ndarray]) -> Column:
        """Projected gradient steps from zero: each adds the member-weighted residual and clips to [0, cap]."""
        if not history:
            return F.lit(0.0)
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in history])
        dot = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
        return F.aggregate(steps, F.lit(0.0), lambda r, g: F.least(cap, F.greatest(F.lit(0.0), r + dot(g))))

    def _fit_rates(self, rounds: int) -> list[np.ndarray]:
        n = len(self.sources)
        if not n or not self.tokens.sum():
            return []
        p, cap = self._membership()
        profiles = cut(self.members.withColumns({"m": p, "cap": cap}).groupBy("m", "cap").agg(F.sum("tokens").cast("double").alias("t")))

        def mass(history: list[np.ndarray] | None) -> np.ndarray:
            """Each domain's expected tokens at the rates that ``history`` leads to; at a rate of 1 without it."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    m, most, t = np.array(b.column("m").to_pylist()).reshape(-1, n + 1), b.column("cap").to_numpy(), b.column("t").to_numpy()
                    rate = np.ones(len(t)) if history is None else np.zeros(len(t))
                    for g in history or []:
                        rate = np.clip(rate + m @ g, 0, most)
                    yield pa.record_batch([pa.array([x]) for x in (rate * t) @ m], names=[f"d{i}" for i in range(n + 1)])

            parts = profiles.mapInArrow(run, ", ".join(f"d{i} double" for i in range(n + 1)))
            return np.array(parts.agg(*[F.sum(f"d{i}") for i in range(n + 1)]).first(), dtype=float)

        # the metric in which steps are taken: tokens a document, and each domain's available tokens
        available = mass(None)
        target = np.append(self.weight * self.total, 0.0)
        reachable = np.append(self.tokens > 0, available[n] > 0)
        history: list[np.ndarray] = []
        for _ in range(rounds):
            gap = np.where(reachable, target - mass(history), 0.0)
            step = gap / np.maximum(available, 1e-9)
            if np.abs(gap).max() < 1e-4 * self.total or history and np.abs(step - history[-1]).max() < 1e-6:
                break
            history.append(step)
        return history

    def rates(self) -> DataFrame:
        """(doc_id, source, tokens, p, rate): how often each document should be used, as a fraction."""
        p, cap = self._membership() if self.sources else (F.col("p"), F.lit(0.0))
        return self.members.withColumn("rate", self._rate(p, cap, self.history))

    def selection(self) -> DataFrame:
        """(doc_id, source, uses, tokens): how often each chosen document is used, and its tokens in one use.

        Every document of a source is used floor(rate) times; one more use goes to those whose hash lies below the
        cut at which the source's tokens come closest to its target.
        """
        r = self.rates().withColumn("bin", F.pmod(F.xxhash64(F.lit(self.seed), "doc_id"), F.lit(BINS)))
        whole = F.floor(F.col("rate") + 1e-9)
        by_bin = r.filter("source IS NOT NULL").groupBy("source", "bin").agg(F.sum("tokens").alias("t"), F.sum((F.col("rate") - whole) * F.col("tokens")).alias("part"))
        run = Window.partitionBy("source").orderBy("bin")
        sums = by_bin.withColumn("upto", F.sum("t").over(run)).withColumn("want", F.sum("part").over(Window.partitionBy("source")))
        better = F.abs(F.col("upto") - F.col("want")) < F.abs(F.col("upto") - F.col("t") - F.col("want"))
        last = sums.filter(better & ((F.col("upto") - F.col("t")) < F.col("want"))).groupBy("source").agg(F.max("bin").alias("last"))
        # one row for each listed source, of which mix_targets bounds the number
        r = r.join(F.broadcast(last), "source", "left")
        extra = F.when(F.col("source").isNull(), F.col("rate") - whole > F.col("bin") / BINS).otherwise(F.col("bin") <= F.coalesce("last", F.lit(-1)))
        uses = (whole + F.when(extra & (F.col("rate") > whole + 1e-9), 1).otherwise(0)).cast("int")
        return r.select("doc_id", "source", uses.alias("uses"), "tokens").filter("uses > 0")

    def shares(self) -> DataFrame:
        """One row for each listed source, and one (source null) for documents without a source: target and actual share.

        source, weight, max_repeats, documents, tokens_available, documents_used, most_uses, tokens_used, share,
        target_tokens, shortfall (target tokens that its text at the cap cannot give).
        """
        used = self.selection().groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("uses").alias("most"), F.sum(F.col("uses") * F.col("tokens")).alias("t"))
        by_source = {r.source: r for r in used.collect()}  # one row for each listed source, and one for none
        total = sum(r.t for r in by_source.values())
        plan = dict(zip(self.sources, zip(self.weight, self.cap, self.documents, self.tokens, strict=True), strict=True))
        rows = []
        for name in [*self.sources, *[s for s in by_source if s is None]]:
            weight, cap, documents, tokens = plan.get(name, (0.0, None, 0, 0))
            r = by_source.get(name)
            n, most, t = (r.n, r.most, r.t) if r else (0, 0, 0)
            target = float(weight * self.total)
            rows.append((name, float(weight), None if cap is None else int(cap), int(documents), int(tokens), n, most, t, target, max(0.0, target - float((cap or 0) * tokens)), t / total if total else 0.0))
        return self.spark.createDataFrame(rows, "source string, weight double, max_repeats int, documents bigint, tokens_available bigint, documents_used bigint, most_uses int, tokens_used bigint, target_tokens double, shortfall double, share double")

    def checks(self, tolerance: float = 0.01) -> DataFrame:
        """(source, weight, max_repeats, documents, cap_kept, share_kept) of each listed source, from what was really selected.

        cap_kept: no document is used more often than allowed. share_kept: the source's selected tokens are within ``tolerance`` of the whole
        from their target, or nearer to it than one more or one less use of the source's longest document.
        """
        longest = F.create_map(*[F.lit(x) for s, n in zip(self.sources, self.longest, strict=True) for x in (s, float(n))]) if self.sources else F.create_map()
        gap, whole = F.abs(F.col("tokens_used") - F.col("target_tokens")), float(self.weight[self.tokens > 0].sum() * self.total)
        share = F.coalesce(gap <= F.greatest(F.lit(tolerance * whole), longest[F.col("source")]), F.lit(False))
        cap = F.col("most_uses") <= F.col("max_repeats")
        return self.shares().filter("source IS NOT NULL").select("source", F.round("weight", 6).alias("weight"), "max_repeats", "documents", cap.alias("cap_kept"), share.alias("share_kept"))
