"""Toxicity scores: boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Labelled rows that the lexicon and the trees are fitted on at most.
SAMPLE = 20000
STEM = 4
#: Second-person words of English, French, German and Spanish.
SECOND = frozenset(
    x.encode()
    for x in "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie ti tus usted ustedes vosotros vuestro".split()
)
_SPACE = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Punctuation at which words end; other signs stay inside words until look-alikes are undone.
_SPLIT = _UPPER.translate(bytes.maketrans(b".,;:?()[]{}\"|/\\<>", b" " * 17))
_PLAIN = bytes.maketrans(b"013457@$!", b"oieastasi")
_DROP = b"*-_+=~^`#%&'."
_EDGE = b"!#$%&*@^~_-`=+"
_ODD = re.compile(rb"[a-z][0-9@$!*_.\-]+[a-z]|\b(?:[a-z][ .*_\-]){3,}[a-z]\b")
NAMES = ("words", "lexicon", "stems", "log_odds", "hidden", "near_second", "second", "capitals", "shouted", "punctuation", "exclaimed", "digits", "odd", "longest_run")


def words_of(data: bytes) -> list[bytes]:
    return [w if w.isalpha() else w.strip(_EDGE) or w for w in data.translate(_SPLIT).split()]


def plain(word: bytes) -> bytes:
    """The word with look-alike signs undone and filler signs dropped."""
    return word.translate(_PLAIN, _DROP)


def _pieces(data: bytes) -> set[bytes]:
    """Words, and stems marked by a leading 0x01, of a text."""
    own = set(words_of(data))
    own |= {plain(w) for w in own if not w.isalpha() and w.isascii()}
    return own | {b"\1" + w.decode("utf-8", "replace")[:STEM].encode() for w in own if len(w) > STEM}


def features(data: bytes, lexicon: dict[bytes, float]) -> list[float]:
    """Dense features of a whole text; all 0 for an empty one."""
    words = words_of(data)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = len(data)
    hits = [i for i, w in enumerate(words) if w in lexicon]
    distinct = set(words)
    stems = sum(1 for w in distinct if len(w) > STEM and b"\1" + w.decode("utf-8", "replace")[:STEM].encode() in lexicon)
    masked = {w for w in distinct if not w.isalpha() and w.isascii() and not w.isdigit()}
    hidden = sum(1 for w in masked if w not in lexicon and plain(w) in lexicon)
    second = [i for i, w in enumerate(words) if w in SECOND]
    near = 0
    if hits and second:
        a, b = np.array(hits), np.array(second)
        k = np.searchsorted(b, a)
        near = int((np.minimum(np.abs(b[np.minimum(k, len(b) - 1)] - a), np.abs(b[np.maximum(k - 1, 0)] - a)) <= 5).sum())
    odds = sum(lexicon[w] for w in distinct if w in lexicon)
    upper = int(counts[65:91].sum())
    letters = upper + int(counts[97:123].sum()) + int(counts[128:].sum())
    signs = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    shouted = sum(1 for w in data.split() if len(w) > 2 and w.isupper()) if upper > n * 0.3 else 0
    odd = sum(1 for w in masked if _ODD.search(w))
    run = max((b - a for a, b in zip([*hits, 0], [*hits[1:], 0], strict=False)), default=0) if len(hits) > 1 else 0
    return [
        math.log1p(n), len(hits) / n, stems / n, odds / math.sqrt(n), hidden / n, near / n, len(second) / n, upper / max(1, letters),
        shouted / n, signs / size, int(counts[33]) / size, int(counts[48:58].sum()) / size, odd / n, math.log1p(max(run, 0)),
    ]


class Trees:
    """Gradient-boosted regression trees for the logistic loss, on at most 32 quantile bins a feature."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.15, least: int = 8):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list[list[tuple]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        mean = float(np.clip(y.mean() if len(y) else 0, 1e-4, 1 - 1e-4))
        self.base = math.log(mean / (1 - mean))
        if len(np.unique(y)) < 2:
            return self
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._walk(tree, x)
        return self

    def _grow(self, binned, gradient, hessian) -> list[tuple]:
        nodes: list[tuple] = []
        waiting = [(np.arange(len(gradient)), 0, None)]
        while waiting:
            rows, depth, parent = waiting.pop()
            k = len(nodes)
            if parent is not None:
                nodes[parent[0]] = nodes[parent[0]][: 3 + parent[1]] + (k,) + nodes[parent[0]][4 + parent[1] :]
            g, h = gradient[rows], hessian[rows]
            whole = g.sum() ** 2 / (h.sum() + 1)
            best = (1e-6, None)
            if depth < self.depth and len(rows) >= 2 * self.least:
                for f in range(binned.shape[1]):
                    if not len(self.cuts[f]):
                        continue
                    m = len(self.cuts[f]) + 1
                    b = binned[rows, f]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (g, h, None))
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                    gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
                    if (i := int(gain.argmax())) is not None and gain[i] > best[0]:
                        best = (gain[i], (f, i))
            if best[1] is None:
                nodes.append((-1, self.rate * g.sum() / (h.sum() + 1), 0.0, -1, -1))
                continue
            f, i = best[1]
            nodes.append((f, 0.0, float(self.cuts[f][i]), -1, -1))
            low = binned[rows, f] <= i
            waiting += [(rows[low], depth + 1, (k, 0)), (rows[~low], depth + 1, (k, 1))]
        return nodes

    def _walk(self, tree: list[tuple], x: np.ndarray) -> np.ndarray:
        f, value, cut, left, right = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            inner = f[at] >= 0
            low = x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, value) of the non-decreasing fit, for linear interpolation."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2], hi]
    knots = [(x, (v + 0.25) / (n + 0.5)) for v, n, lo, hi in blocks for x in ((lo, hi) if hi > lo else (lo,))]
    x, p = (np.array(c) for c in zip(*knots, strict=True)) if knots else (np.zeros(1), np.full(1, 0.5))
    return x, np.maximum.accumulate(p)


class Model:
    """Lexicon of log odds, trees, calibration."""

    def __init__(self, lexicon: dict[bytes, float], trees: Trees, knots: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def predict(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features((t or "").encode("utf-8", "surrogatepass"), self.lexicon) for t in texts]).reshape(-1, len(NAMES))
        return np.clip(np.interp(self.trees.score(x), *self.knots), 0.0, 1.0)


def fold() -> F.Column:
    """crc32 of doc_id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        clean, bad, n = Counter(), Counter(), [0, 0]
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n[label] += 1
            (bad if label else clean).update(_pieces((text or "").encode("utf-8", "surrogatepass")))
        clean[b""], bad[b""] = n
        keys = list(clean | bad)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (clean, bad))], ["piece", "clean", "bad"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most sample labelled rows outside fold 0, taken by a hash of doc_id: lexicon, trees and calibration
    on three parts of them, so none sees what another has fitted. Of rows that share a doc_id one is taken, by a hash of
    its text. The driver gets pieces that three toxic rows of the sample or more hold, and the features of the sampled rows,
    whatever the input."""
    named = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    named = named.where(fold() != 0).orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(named), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = materialize(rows.withColumn("part", F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(10))), "toxic-sample")
    counts = rows.where("part < 5").select("text", (F.col("y") > 0).cast("int").alias("y")).mapInArrow(_count, "piece binary, clean long, bad long")
    counts = materialize(counts.groupBy("piece").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).where("bad >= 3 or piece = X''"), "toxic-pieces")
    sizes = counts.where("piece = X''").first()
    clean, bad = (sizes["clean"] or 0, sizes["bad"] or 0) if sizes else (0, 0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    lexicon = {bytes(r.piece): r.odds for r in counts.where("piece <> X''").withColumn("odds", odds).where("odds > 1.6").collect()}

    def run(batches):
        for b in batches:
            x = [features((t or "").encode("utf-8", "surrogatepass"), lexicon) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "y", "part"])

    found = rows.where("part >= 5").orderBy("doc_id").select("text", "y", "part").mapInArrow(run, "x array<double>, y int, part long").toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, len(NAMES))
    y, last = (found["y"].to_numpy() > 0).astype(float), found["part"].to_numpy() >= 8
    trees = Trees().fit(x[~last], y[~last])
    return Model(lexicon, trees, isotonic(trees.score(x[last]), y[last]))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text); labels (doc_id, toxic) only train.

    Scores read nothing but the text. Null and empty texts get the score of a text without features; rows that repeat
    or have a null doc_id are scored like others; without labels of both kinds all scores are the base rate, or 0.5.
    Labels of a doc_id that disagree count as toxic. Other columns are ignored.
    """
    model = train(docs, labels, sample)

    def run(batches):
        for b in batches:
            p = np.concatenate([model.predict(b.column(2).slice(i, 500).to_pylist()) for i in range(0, b.num_rows, 500)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
