"""Term weights as long rows (B04-B06): a posting is (id, term, weight), whatever the vocabulary."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Index postings up to which fitted(settle=...) sends them to all tasks, so that no query posting is shuffled.
SMALL = 1 << 18


def term_counts(df: DataFrame, keys: list[str], tokens: Column, words: dict[str, Column] | None = None) -> DataFrame:
    """(keys, term, tf) of each row's tokens; counts combine before the shuffle. Tokens that lie inside words, of the one column
    of words, are cut once from each different word of a key: words = {that column: the words of its text}."""
    if words is None:
        return df.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    ((text, cut),) = words.items()
    each = df.select(*keys, F.explode(cut).alias(text)).groupBy(*keys, text).agg(F.count(F.lit(1)).alias("n"))
    # an inner explode would be planned with a filter that cuts the word once more
    each = each.select(*keys, "n", F.explode_outer(tokens).alias("term")).where("term is not null")
    return each.groupBy(*keys, "term").agg(F.sum("n").alias("tf"))


def document_frequency(counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, n): n_docs is a one-row frame (n), joined as a constant."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n_docs))


def tfidf(counts: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), unit length; terms unknown to df go first."""
    raw = counts.join(df, "term").withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def bm25(counts: DataFrame, df: DataFrame, key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, term, weight) of the index side; the query side weighs by raw counts."""
    size = counts.groupBy(key).agg(F.sum("tf").alias("size"))
    mean = size.agg(F.greatest(F.avg("size"), F.lit(1e-9)).alias("mean"))
    rows = counts.join(df, "term").join(size, key).crossJoin(F.broadcast(mean))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return rows.select(key, "term", (idf * part).alias("weight"))


def raw_weights(counts: DataFrame, key: str) -> DataFrame:
    return counts.select(key, "term", F.col("tf").cast("double").alias("weight"))


#: Cells, terms by candidates, up to which counted_small() has an index.
CELLS = 1 << 22


def counted_small(index: DataFrame, key: str, tokens: Column, words: dict[str, Column] | None = None) -> tuple[pa.Table, int] | None:
    """The counts (key, term, tf) of a small index and the number of its keys, for search.small_index_hits(); None of a larger."""
    counts = term_counts(index, [key], tokens, words)
    found = counts.limit(SMALL + 1).toArrow()
    if found.num_rows > SMALL or len(found[key].unique()) * len(found["term"].unique()) > CELLS:
        return None
    return found, index.agg(F.countDistinct(key)).first()[0]


def fitted(index: DataFrame, queries: DataFrame, index_key: str, query_key: str, index_tokens: Column, query_tokens: Column, scoring: str = "tfidf", settle: Callable[[DataFrame], DataFrame] | None = None, words: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Posting rows of both sides, fitted on the whole index: (index_key, term, weight), (query_key, term, weight).

    With settle, which writes a table, the postings and frequencies of a small index are written once and broadcast, and
    queries are dealt by their key before they are cut: then only texts are shuffled, and hits stay where their query is. words is that of term_counts, for both sides.
    """
    own = term_counts(index, [index_key], index_tokens, words)
    if settle:
        own, queries = settle(own), queries.repartition(query_key)
    df = document_frequency(own, index.agg(F.countDistinct(index_key).alias("n")))
    small = settle is not None and own.count() <= SMALL
    df = F.broadcast(settle(df)) if small else df
    asked = term_counts(queries, [query_key], query_tokens, words)
    if scoring == "bm25":
        own, asked = bm25(own, df, index_key), raw_weights(asked.join(df.select("term"), "term", "left_semi"), query_key)
    else:
        own, asked = tfidf(own, df, index_key), tfidf(asked, df, query_key)
    return F.broadcast(settle(own)) if small else own, asked
