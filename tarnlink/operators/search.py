"""Blocks and candidate search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.similarity import osa_udf

DIGITS = 6


def top_k(scores: DataFrame, k: int, query: str = "query_id", candidate: str = "s1_id", score: str = "score", digits: int = DIGITS) -> DataFrame:
    """The k best positive scores of each query, rank from 1; ties to the smaller candidate. Ranks cut before the
    shuffle (WindowGroupLimit)."""
    rows = scores.withColumn(score, F.round(score, digits)).where(F.col(score) > 0)
    best = Window.partitionBy(query).orderBy(F.desc(score), candidate)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def in_blocks(left: DataFrame, right: DataFrame, country: str | None = None, state: str | None = None) -> list[tuple[DataFrame, DataFrame, list[str]]]:
    """Pairs of frames and their equality keys. A left row with a state meets its state only; one without
    meets the whole country, as two equi-joins and no OR. Without keys, everything meets."""
    if country is None:
        return [(left, right, [])]
    if state is None:
        return [(left, right, [country])]
    known = left.where(F.col(state).isNotNull() & (F.col(state) != ""))
    rest = left.where(F.col(state).isNull() | (F.col(state) == "")).drop(state)
    return [(known, right, [country, state]), (rest, right.drop(state), [country])]


def posting_scores(queries: DataFrame, index: DataFrame, query: str, candidate: str, keys: list[str] = ()) -> DataFrame:
    """Sum of products over common terms of a block; postings carry their block keys."""
    hits = queries.withColumnRenamed("weight", "qw").join(index.withColumnRenamed("weight", "sw"), [*keys, "term"])
    return hits.groupBy(query, candidate).agg(F.sum(F.col("qw") * F.col("sw")).alias("score"))


def combine_fields(name_scores: DataFrame, address_scores: DataFrame, query: str, candidate: str, boost: float = 2.0) -> DataFrame:
    """Boost * name + address in one aggregation; a candidate needs only one of both."""
    zero = F.lit(0.0)
    rows = name_scores.select(query, candidate, F.col("score").alias("n"), zero.alias("a")).unionByName(address_scores.select(query, candidate, zero.alias("n"), F.col("score").alias("a")))
    rows = rows.groupBy(query, candidate).agg(F.sum("n").alias("name_score"), F.sum("a").alias("address_score"))
    return rows.withColumn("score", F.col("name_score") * boost + F.col("address_score"))


def slab_scores(queries: DataFrame, index: DataFrame, query: str, candidate: str, k: int, tiles: int = 1, down: int = 1) -> DataFrame:
    """B07 for small vocabularies (character n-grams): blocks of queries and of candidates become dense slabs whose
    product is one matrix multiplication; each task holds one tile of either side, and returns k hits a query. Queries
    are cut into `tiles` and candidates into `down`, so a query is copied `down` times only."""
    place = lambda m, s: F.pmod(F.xxhash64(F.lit(s), "id"), F.lit(m)).cast("int")
    span = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.select(F.col(query).cast("long").alias("id"), "term", "weight").withColumn("a", place(tiles, 1)).withColumn("b", span(down))
    right = index.select(F.col(candidate).cast("long").alias("id"), "term", "weight").withColumn("b", place(down, 2)).withColumn("a", span(tiles))

    def multiply(x: pa.Table, y: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], pa.int64()), "s": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not x.num_rows or not y.num_rows:
            return empty
        terms = {t: i for i, t in enumerate(set(y["term"].to_pylist()))}

        def dense(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            ids, rows = np.unique(t["id"].to_numpy(), return_inverse=True)
            cols = np.array([terms.get(v, -1) for v in t["term"].to_pylist()])
            out = np.zeros((len(ids), len(terms)))
            out[rows[cols >= 0], cols[cols >= 0]] = t["weight"].to_numpy()[cols >= 0]
            return ids, out

        (qi, qm), (si, sm) = dense(x), dense(y)
        parts = []
        for at in range(0, len(qi), 512):
            score = np.round(qm[at : at + 512] @ sm.T, DIGITS)
            for q, row in zip(qi[at : at + 512], score, strict=True):
                best = np.lexsort((si, -row))[:k]
                best = best[row[best] > 0]
                parts.append((np.full(len(best), q), si[best], row[best]))
        q, s, v = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.table({"q": q, "s": s, "score": v})

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(multiply, "q long, s long, score double")
    return top_k(found.toDF(query, candidate, "score"), k, query, candidate)


#: Which code points up to U+024F are letters or digits; beyond, texts hold nothing but those and blanks.
_LETTER = np.array([chr(c).isalnum() for c in range(0x250)])


class Letters:
    """The code points of texts, and the row of each."""

    def __init__(self, texts: list[str], rows: np.ndarray):
        self.codes = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.rows = np.repeat(rows, [len(t) + 1 for t in texts])
        self.inside = _LETTER[np.minimum(self.codes, 0x24F)] | (self.codes >= 0x250)


class SmallIndex:
    """Unit TF-IDF weights of an index (id, term, tf) as a matrix of terms by candidates, and how its terms are found in texts."""

    def __init__(self, counts: pa.Table, n: int, window: tuple[int, tuple[int, ...]] | None):
        ids, terms = (counts.column(i).combine_chunks().dictionary_encode("encode") for i in (0, 1))
        names = ids.dictionary.to_pylist()
        order = sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i]))
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        rows, cols = terms.indices.to_numpy(), place[ids.indices.to_numpy()]
        df = np.bincount(rows)
        self.ids = ids.dictionary.take(pa.array(order, pa.int64()))
        self.idf = np.log((1 + n) / (1 + df)) + 1
        self.matrix = np.zeros((len(df), len(names)))
        self.matrix[rows, cols] = (1 + np.log(counts.column(2).to_numpy())) * self.idf[rows]
        self.matrix /= np.sqrt((self.matrix**2).sum(axis=0))
        texts, self.window = terms.dictionary.to_pylist(), window
        if window is None:
            self.terms = {t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(texts)}
            return
        # a term's number in an alphabet of the index's own characters, 0 being any other
        own = sorted({c for t in texts for c in t})
        self.alphabet = np.zeros(0x110000, np.int64)
        self.alphabet[[ord(c) for c in own]] = np.arange(1, len(own) + 1)
        self.base = len(own) + 1
        found = np.array([self.number(np.array([ord(c) for c in t])[:, None])[0] for t in texts], np.int64)
        self.sorted = np.argsort(found)
        self.numbers = found[self.sorted]

    def number(self, codes: np.ndarray | list[np.ndarray]) -> np.ndarray:
        out = self.alphabet[codes[0]]
        for x in codes[1:]:
            out = out * self.base + self.alphabet[x]
        return out

    def in_letters(self, texts: Letters, n: int) -> np.ndarray:
        """How often each of n rows has each term that lies inside a word."""
        wide, taken = self.window
        last = max(0, len(texts.codes) - wide + 1)
        at = texts.inside[:last].copy()
        for i in range(1, wide):
            at &= texts.inside[i : i + last]
        at = np.flatnonzero(at)
        found = self.number([texts.codes[at + i] for i in taken])
        where = np.minimum(np.searchsorted(self.numbers, found), len(self.numbers) - 1)
        known = self.numbers[where] == found if len(self.numbers) else np.zeros(len(found), bool)
        return self.counted(texts.rows[at[known]], self.sorted[where[known]], n)

    def in_words(self, texts: list[str], rows: np.ndarray, n: int) -> np.ndarray:
        """How often each of n rows has each term; words are those of tokens.words() of texts in lower case."""
        get, found = self.terms.get, []
        for t in texts:  # bytes are split at the white space of \\s
            found.append([i for w in t.encode("utf-8", "surrogatepass").replace(b",", b" ").split() if (i := get(w)) is not None])
        return self.counted(np.repeat(rows, [len(x) for x in found]), np.array([i for x in found for i in x], np.int64), n)

    def counted(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows * len(self.idf) + terms, minlength=n * len(self.idf)).reshape(n, len(self.idf))

    def best(self, tf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, candidate, score, rank) of the k best positive scores of each row, ties to the smaller candidate."""
        w = np.zeros(tf.shape)
        at = tf > 0
        w[at] = 1 + np.log(tf[at])
        w *= self.idf
        norm = np.sqrt((w * w).sum(axis=1))
        score = np.round((w @ self.matrix) / np.where(norm > 0, norm, 1)[:, None], DIGITS)
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(score, top, 1)
        row, rank = np.nonzero(value > 0)
        return row, top[row, rank], value[row, rank], rank + 1


#: Texts that small_index_hits() scores at once.
AT_ONCE = 256


def small_index_hits(queries: DataFrame, query: str, candidate: str, indexes: dict[str, tuple[pa.Table, int]], k: int) -> DataFrame:
    """(query, candidate, score, rank, method): the k best of each query (query, text) by each method, as posting_scores() and
    top_k() over unit TF-IDF weights have them.

    indexes holds, for each method, the counts (candidate, term, tf) and the number of candidates; every task has them as
    matrices, so no posting of a query is made into a row or shuffled. Methods are "words" and those of tokens.INSIDE. Texts are
    dealt by their query, whose texts may be several and are counted together.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {m: SmallIndex(*x, tokens.INSIDE.get(m)) for m, x in indexes.items()}

        kind, held = None, None  # the last query and its counts, as more texts of it may come

        def hits(names: list, counts: dict[str, np.ndarray]) -> pa.RecordBatch:
            parts = []
            ids = pa.array(names, kind)
            for m, x in index.items():
                row, col, score, rank = x.best(counts[m], k)
                parts.append(pa.record_batch([ids.take(pa.array(row)), x.ids.take(pa.array(col)), pa.array(score), pa.array(rank, pa.int64()), pa.array([m] * len(row), pa.string())], [query, candidate, "score", "rank", "method"]))
            return pa.Table.from_batches(parts).combine_chunks().to_batches()

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                own, low, odd = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)
                names = [*held[0], *own[:1]] if held and held[0] != own[:1] else own[:1]
                at_row = [len(names) - 1]
                for x, y in zip(own, own[1:], strict=False):
                    if x != y:
                        names.append(y)
                    at_row.append(len(names) - 1)
                rows, counts = np.array(at_row, np.int64), {}
                letters = Letters([" ".join(odd[i].as_py()) if odd[i].is_valid else t for i, t in enumerate(low)], rows)
                for m, x in index.items():
                    counts[m] = x.in_letters(letters, len(names)) if x.window else x.in_words(low, rows, len(names))
                    if held:
                        counts[m][0] += held[1][m]
                if len(names) > 1:
                    yield from hits(names[:-1], {m: c[:-1] for m, c in counts.items()})
                held = names[-1:], {m: c[-1].copy() for m, c in counts.items()}
        if held:
            yield from hits(held[0], {m: c[None] for m, c in held[1].items()})

    low = F.lower(F.coalesce("text", F.lit("")))
    texts = queries.select(query, low.alias("text")).repartition(query).sortWithinPartitions(query)
    id_type = lambda t: "bigint" if t in (pa.int64(),) else "int" if t == pa.int32() else "string"
    first = next(iter(indexes.values()))[0]
    schema = f"{query} {dict(queries.dtypes)[query]}, {candidate} {id_type(first.schema.field(0).type)}, score double, rank long, method string"
    return texts.select(query, "text", tokens.beyond("text").alias("odd")).mapInArrow(run, schema)


def fuzzy_expansions(words: DataFrame, vocabulary: DataFrame, word: str, term: str, most: int, edits: int = 2) -> DataFrame:
    """(word, term, distance): vocabulary terms that share the first two letters and are within edits (optimal
    string alignment), the nearest first, then by term, at most `most` a word."""
    left = words.select(word).distinct().withColumn("p", F.substring(word, 1, 2))
    right = vocabulary.select(term).distinct().withColumn("p", F.substring(term, 1, 2))
    near = left.join(right, "p").where(F.abs(F.length(word) - F.length(term)) <= edits)
    near = near.withColumn("distance", osa_udf(F.col(word), F.col(term))).where(F.col("distance") <= edits)
    first = Window.partitionBy(word).orderBy("distance", term)
    return near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).select(word, term, "distance")


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays, null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def knn(queries: DataFrame, index: DataFrame, query: str, candidate: str, vector: str, k: int, keys: list[str] = (), tile: int = 8192) -> DataFrame:
    """Exact nearest neighbours by cosine, by tiles of unit vectors (query, candidate, score, rank); a row
    is no neighbour of itself. keys restrict both sides to equal values and are part of the tile."""
    n_left, n_right = queries.count(), index.count()
    across, down = max(1, -(-n_left // tile)), max(1, -(-n_right // tile))
    place = lambda m, s: F.pmod(F.xxhash64(F.lit(s), "id"), F.lit(m)).cast("int")
    span = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.select(*keys, F.col(query).alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("a", place(across, 1)).withColumn("b", span(down))
    right = index.select(*keys, F.col(candidate).alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("b", place(down, 2)).withColumn("a", span(across))

    def multiply(x: pa.Table, y: pa.Table) -> pa.Table:
        names = ("q", "s", "score")
        if not x.num_rows or not y.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "s": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

        def unit(t: pa.Table) -> np.ndarray:
            m = np.array(t["v"].to_pylist(), np.float64)
            return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

        qi, si, a, b = x["id"].to_numpy(), y["id"].to_numpy(), unit(x), unit(y)
        parts = []
        for at in range(0, len(qi), 256):
            score = np.round(a[at : at + 256] @ b.T, DIGITS)
            for q, row in zip(qi[at : at + 256], score, strict=True):
                row[si == q] = -2
                some = np.argpartition(-row, min(k + 64, len(row) - 1))[: k + 65] if len(row) > k + 65 else np.arange(len(row))
                some = np.flatnonzero(row >= np.sort(row[some])[::-1][min(k, len(some)) - 1]) if len(some) else some
                best = some[np.lexsort((si[some], -row[some]))][:k]
                best = best[row[best] > -2]
                parts.append((np.full(len(best), q), si[best], row[best]))
        return pa.table(dict(zip(names, (np.concatenate(c) for c in zip(*parts, strict=True)), strict=True)))

    by = [*keys, "a", "b"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(multiply, "q long, s long, score double").toDF(query, candidate, "score")
    best = Window.partitionBy(query).orderBy(F.desc("score"), candidate)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def gap_prune(hits: DataFrame, gap: float, query: str = "query_id", candidate: str = "s1_id") -> DataFrame:
    """Distinct pairs within gap of the best score of their query in some search."""
    best = F.max("score").over(Window.partitionBy(query, "method"))
    return hits.withColumn("_best", best).where(F.col("_best") - F.col("score") <= gap).select(query, candidate).distinct()


def rank_prune(fused: DataFrame, top: int) -> DataFrame:
    """B19, B12."""
    return fused.where(F.col("fused_rank") <= top)
