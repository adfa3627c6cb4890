"""BM25 over an inverted index: statistics of the whole collection, queries joined with postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import tokens
from foliant.plans.lineage import cut

# The scoring's constants.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query terms are broadcast up to this many rows, counted beforehand; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


#: (query, item) pairs that one task sums up, at the most a query can meet; the number of tasks follows from it.
PAIRS_A_TASK = 1_000_000


class LexicalIndex:
    """words(item, dl, w), term_stats(term, df, idf) and the collection's n, avgdl and avg_idf.

    Items are rows with an id and a text; a null text is empty and counts in n. A repeated row counts once; rows
    with a null id are left out. A term in more than half of the items has a negative idf, which is replaced by a quarter of the mean
    idf. An empty collection answers nothing.

    Scale: documents are spread by their id once, and all that is done to a document from there on, counting its words, meeting the query
    terms, summing up its scores and cutting to the best, happens where it is; only each task's k best are shuffled again. A term that is in
    every document is spread over all tasks that way. Document frequencies combine before their shuffle.
    """

    def __init__(self, items: DataFrame, item: str, text: str):
        self.items = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).filter("item IS NOT NULL")
        words = self.words()
        # one row of no term for each item carries its length, so that one pass gives all statistics
        terms = words.select("dl", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("w"))).alias("term"))
        df = cut(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("total")))
        whole = df.filter("term IS NULL").first()
        self.n, total = (whole.df, whole.total) if whole else (0, 0)
        self.avgdl = (total or 0) / self.n if self.n else 0.0
        raw = df.filter("term IS NOT NULL").select("term", "df", (F.log(self.n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
        self.avg_idf = raw.agg(F.avg("raw")).first()[0] or 0.0
        self.term_stats = raw.select("term", "df", F.when(F.col("raw") < 0, EPSILON * self.avg_idf).otherwise(F.col("raw")).alias("idf"))

    def words(self, tasks: int | None = None) -> DataFrame:
        """(item, dl, w): each item once with its words, spread by item over ``tasks``, or as many as the session says."""
        spread = self.items.repartition(tasks, "item") if tasks else self.items.repartition("item")
        return spread.distinct().select("item", tokens("text").alias("w")).select("item", F.size("w").alias("dl"), "w")

    def scores(self, queries: DataFrame, query: str, text: str) -> DataFrame:
        """(query_id, item, score): every item with a positive score, rounded to 6 digits. A term repeated in a query counts as often."""
        q = queries.select(F.col(f"`{query}`").alias("query_id"), F.col(f"`{text}`").alias("t")).filter("query_id IS NOT NULL").distinct()
        terms = q.select("query_id", F.explode(tokens("t")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        terms = cut(terms.join(self.term_stats, "term"))
        asked, rows = terms.agg(F.countDistinct("query_id"), F.count(F.lit(1))).first()
        known = terms.select("term").distinct()
        if rows <= BROADCAST_ROWS:
            terms, known = F.broadcast(terms), F.broadcast(known)
        words = self.words(max(int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.n * asked // PAIRS_A_TASK)) if asked else None)
        tf = words.select("item", "dl", F.explode("w").alias("term")).join(known, "term", "left_semi").groupBy("item", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
        norm = K1 * (1 - B + B * F.col("dl") / (self.avgdl or 1.0))
        one = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
        hits = tf.join(terms, "term").groupBy("query_id", "item").agg(F.round(F.sum(one), 6).alias("score"))
        return hits.filter("score > 0")

    def search(self, queries: DataFrame, query: str, text: str, k: int = 8) -> DataFrame:
        """(query_id, item, score, rank): the k best of each query, ties by id."""
        return top_k(self.scores(queries, query, text), k)


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """The k best rows (query_id, item, score) of each query with their rank from 1; ties by item."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))
