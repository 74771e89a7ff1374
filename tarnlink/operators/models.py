"""Scorers, embedders and the match classifier."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions import tokens
from .relational import running


class PairScorer(Protocol):
    """Adds logit to pairs with text columns left and right."""

    def score(self, pairs: DataFrame) -> DataFrame: ...


class Embedder(Protocol):
    """Adds a unit vector column to rows with a text column."""

    def embed(self, rows: DataFrame, text: str, out: str) -> DataFrame: ...


class HashedEmbedder:
    """Character trigrams hashed to a unit vector."""

    def __init__(self, size: int = 256):
        self.size = size

    def embed(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        size = self.size

        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            def of(x):
                b = np.frombuffer(f"  {(x or '').lower()} ".encode(), np.uint8).astype(np.uint32)
                v = np.bincount((b[:-2] * 31 + b[1:-1] * 1031 + b[2:] * 32771) % size, minlength=size).astype(np.float32)
                n = float(np.linalg.norm(v))
                return (v / n if n else v).tolist()

            return texts.map(of)

        return rows.withColumn(out, run(text))


def murmur3(data: bytes, seed: int = 42) -> int:
    """The signed 32-bit hash that HashingTF takes of a term's bytes."""
    h, whole = seed, len(data) & ~3
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        if i < whole:
            h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


class Crosses:
    """The places of the crossed words of two texts in a vector, as HashingTF has them."""

    #: Words and texts of which places are remembered.
    MOST = 1 << 17

    def __init__(self, size: int):
        self.size, self.lefts, self.rights, self.texts = size, {}, {}, {}
        self.grades, self.bias = [self.place(f"share={i}") for i in range(11)], self.place("bias")

    def place(self, term: str) -> int:
        return murmur3(term.encode("utf-8", "surrogatepass")) % self.size

    def _kept(self, known: dict, key: str, make: Callable[[str], object]):
        found = known.get(key)
        if found is None:
            if len(known) >= self.MOST:
                known.clear()
            found = known[key] = make(key)
        return found

    def left_place(self, word: str) -> int:
        return self._kept(self.lefts, word, lambda w: self.place("left=" + w))

    def left(self, words: list[str]) -> tuple[set[str], np.ndarray]:
        """The words of a left text, and how many of them have each place."""
        own = set(words)
        return own, np.bincount(np.array([self.left_place(w) for w in own], np.int64), minlength=self.size)

    def right(self, text: str, words: Callable[[], list[str]]) -> dict[str, tuple[int, int]]:
        """The words of a right text, and their places if the left text has them and if not."""
        places = lambda w: (self.place("both=" + w), self.place("right=" + w))
        return self._kept(self.texts, text, lambda _: {w: self._kept(self.rights, w, places) for w in words()})

    def of(self, left: tuple[set[str], np.ndarray], right: dict[str, tuple[int, int]]) -> bytes:
        """The bits of the places that are taken."""
        own, counts = left[0], left[1].copy()
        both, on = 0, []
        for w, (shared, alone) in right.items():
            if w in own:
                both += 1
                counts[self.left_place(w)] -= 1
                on.append(shared)
            else:
                on.append(alone)
        share = both / max(len(own) + len(right) - both, 1)
        counts[[*on, self.grades[math.floor(share * 10)], self.bias]] = 1
        return np.packbits(counts > 0).tobytes()


class CrossScorer:
    """Logistic regression over hashed token crosses of a pair; scores are the mean of the eligible models."""

    def __init__(self, size: int = 1 << 14):
        self.size, self.models = size, {}

    def featured(self, pairs: DataFrame) -> DataFrame:
        """pairs with _bits, a vector of zeros and ones, in place of left and right: hashed words that both texts have, that only
        the left or only the right one has, and a grade of their share. Where a column same is true, the left text is that of the
        row before."""
        rest, size = [c for c in pairs.columns if c not in ("left", "right", "same")], self.size
        pairs = pairs if "same" in pairs.columns else pairs.withColumn("same", F.lit(False))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cross, left = Crosses(size), None
            for b in batches:
                col = {x: b.column(b.schema.get_field_index(x)) for x in ("left", "right", "same", "_left", "_right")}
                found = []
                for i, (same, right) in enumerate(zip(col["same"].to_pylist(), col["right"].to_pylist(), strict=True)):
                    if not same:
                        left = cross.left(tokens.python_word_chars(col["left"][i].as_py(), lambda: col["_left"][i].as_py()))  # noqa: B023
                    found.append(cross.of(left, cross.right(right, lambda: tokens.python_word_chars(right, lambda: col["_right"][i].as_py()))))  # noqa: B023
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(found, pa.binary())], [*rest, "_bits"])

        schema = StructType([*(pairs.schema[c] for c in rest), StructField("_bits", BinaryType())])
        return pairs.withColumns({"_left": F.when(~F.col("same"), tokens.beyond("left")), "_right": tokens.beyond("right")}).mapInArrow(run, schema)

    def vectors(self, pairs: DataFrame) -> DataFrame:
        """featured() pairs with the vector _v of _bits; pairs of texts are featured first."""
        pairs, size = pairs if "_bits" in pairs.columns else self.featured(pairs), self.size
        rest = [c for c in pairs.columns if c != "_bits"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (x.slice(at, 1024) for x in batches for at in range(0, x.num_rows, 1024)):
                bits = b"".join(b.column(b.schema.get_field_index("_bits")).to_pylist())
                rows, places = np.nonzero(np.unpackbits(np.frombuffer(bits, np.uint8).reshape(b.num_rows, -1), axis=1))
                ends = np.searchsorted(rows, np.arange(b.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (places.astype(np.int32), np.ones(len(places)))]
                fixed = [pa.array(np.full(b.num_rows, x, t)) for x, t in ((0, np.int8), (size, np.int32))]
                vector = pa.StructArray.from_arrays([*fixed, *lists], ["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), vector], [*rest, "_v"])

        return pairs.mapInArrow(run, StructType([*(pairs.schema[c] for c in rest), StructField("_v", VectorUDT())]))

    def fit(self, pairs: DataFrame, fold: str = "A") -> CrossScorer:
        model = LogisticRegression(featuresCol="_v", labelCol="label", regParam=0.01, maxIter=30)
        kept = pairs.select("label", *(c for c in ("left", "right", "same", "_bits") if c in pairs.columns))
        self.models[fold] = model.fit(self.vectors(kept).select("_v", F.col("label").cast("double").alias("label")))
        return self

    def score(self, pairs: DataFrame, fold: str | None = None) -> DataFrame:
        """With a fold column, a model never scores the fold it was fitted on, unless it is the only one. pairs may be featured()."""
        rows = self.vectors(pairs)
        total, n = F.lit(0.0), F.lit(0)
        for name, model in self.models.items():
            rows = model.transform(rows).withColumn(f"_l{name}", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")
            may = F.lit(True) if fold is None or len(self.models) == 1 else F.col(fold) != name
            total, n = total + F.when(may, F.col(f"_l{name}")).otherwise(0.0), n + may.cast("int")
        rows = rows.withColumn("logit", total / F.nullif(n, F.lit(0)))
        return rows.drop("_v", *(f"_l{m}" for m in self.models))


def batches_by_length(pairs: DataFrame, *texts: str) -> DataFrame:
    """Rows of a partition in order of length, so that batches pad little."""
    return pairs.sortWithinPartitions(sum((F.length(t) for t in texts), F.lit(0)))


def with_flags(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Nulls become 0 and a flag of their own, since the trees take no NaN."""
    cols = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features} | {f"{f}_missing": F.col(f).isNull().cast("double") for f in features}
    return df.withColumns(cols), [*features, *(f"{f}_missing" for f in features)]


class MatchClassifier:
    """Boosted trees over pair features."""

    def __init__(self, features: list[str], rounds: int = 30, depth: int = 5, step: float = 0.2, seed: int = 7):
        self.features, self.model = features, None
        self.trees = GBTClassifier(featuresCol="_v", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=5, subsamplingRate=0.8, seed=seed)

    def fit(self, pairs: DataFrame, label: str = "label") -> MatchClassifier:
        rows, names = with_flags(pairs, self.features)
        rows = rows.withColumn("label", F.col(label).cast("double"))
        self.model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_v"), self.trees]).fit(rows)
        return self

    def predict(self, pairs: DataFrame) -> DataFrame:
        """pairs with p, the probability of a match."""
        rows, _ = with_flags(pairs, self.features)
        kept = [c for c in pairs.columns if c not in self.features]
        return self.model.transform(rows).select(*kept, *self.features, vector_to_array("probability")[1].alias("p"))

    def importance(self) -> list[tuple[str, float]]:
        names = [*self.features, *(f"{f}_missing" for f in self.features)]
        return sorted(zip(names, self.model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))

    def rounds_on(self, pairs: DataFrame) -> list[float]:
        """The log loss of every prefix of the trees on held-out pairs."""
        rows, _ = with_flags(pairs, self.features)
        rows = self.model.stages[0].transform(rows.withColumn("label", F.col("label").cast("double")))
        return list(self.model.stages[-1].evaluateEachIteration(rows, "logistic"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> MatchClassifier:
        self.model = PipelineModel.load(path)
        return self


def average_precision(scored: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """Sum of recall steps times precision over descending distinct scores, in one row (average_precision)."""
    per = scored.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n"))
    per = running(per, [F.desc(score)], {"ctp": "tp", "cn": "n"})
    return per.agg((F.sum(F.col("tp") * F.col("ctp") / F.col("cn")) / F.nullif(F.sum("tp"), F.lit(0))).alias("average_precision"))


def log_loss(scored: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    p = F.greatest(F.least(F.col(score), F.lit(1 - 1e-7)), F.lit(1e-7))
    return scored.agg((-F.avg(F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"))
