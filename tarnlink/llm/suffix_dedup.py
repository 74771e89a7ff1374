"""Repeated byte strings across documents, found with a run-length compressed Burrows-Wheeler index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, fetch_texts, materialize, maybe_in, partitions, prefilter, release, salted_lookup

#: Matches of this many bytes count; anchors are grams of GRAM bytes.
LENGTH, GRAM = 100, 32
#: Bytes of zones that one index holds, about.
INDEX = 1 << 19
#: Distinct zones of a gram that one index holds at most; the windows of other grams are told apart by more bytes first.
ZONES = 2048
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E6C63D0876A9A35)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))


@lru_cache(1)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INV):
        x = np.full(size, base)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class Hashes:
    """Hashes of any substrings of one document: at(starts, ends)."""

    def __init__(self, data: bytes):
        n = len(data)
        self.power, self.back = _tables(1 << 18) if n < 1 << 18 else _tables.__wrapped__(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * self.power[:n], out=self.total[1:])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _scramble((self.total[ends] - self.total[starts]) * self.back[starts])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.total) - k
        return _scramble((self.total[k:] - self.total[:n]) * self.back[:n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...] | None:
    """(gram hash, zone hash, first and last window start, place) of each anchor of a document.

    The anchor of a window of length bytes is its leftmost gram of least hash, so equal windows have equal grams at
    the same place in them; the windows of one anchor start at consecutive bytes, and their union is its zone.
    """
    windows = len(data) - length + 1
    if windows < 1:
        return None
    hashes = Hashes(data)
    grams = hashes.grams(gram)
    span, mask = length - gram + 1, np.uint64((1 << 24) - 1)
    firsts, places = [], []
    for start in range(0, windows, 1 << 23):  # a place has 24 bits
        stop = min(windows, start + (1 << 23))
        low = (grams[start : stop + span - 1] & ~mask) | np.arange(stop + span - 1 - start, dtype=np.uint64)
        width = 1
        while width < span:  # sliding minimum by doubling
            step = min(width, span - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        at = (low & mask).view(np.int64) + start
        new = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        if places and places[-1][-1] == at[0]:
            new = new[1:]
        firsts.append(new + start)
        places.append(at[new])
    first, at = np.concatenate(firsts), np.concatenate(places)
    last = np.concatenate((first[1:] - 1, [windows - 1]))
    zone = hashes.at(first, last + length) + (at - first).astype(np.uint64) * _BASE
    return grams[at], _scramble(zone), first, last, at


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of zones, with suffixes sampled at the ends of its runs.

    For a run head at suffix rank j it keeps SA[j], SA[j - 1] and their common prefix. Between sampled places of the
    text both the lexicographic neighbour and the match length follow by counting, so matches stream from the samples.
    """

    def __init__(self, zones: list[bytes]):
        lengths = np.array([len(x) for x in zones], np.int64)
        ends = np.cumsum(lengths + 1)
        n, m = int(ends[-1]), len(zones)
        text = np.frombuffer(b"\0".join(zones) + b"\0", np.uint8).astype(np.int64) + m
        text[ends - 1] = np.arange(m)  # each zone ends in a symbol of its own
        self.n, self.left = n, np.repeat(ends - 1, lengths + 1) - np.arange(n)
        levels, depth, deepest = [(1, text)], 1, int(lengths.max(initial=0)) + 1
        while True:
            rank = levels[-1][1]
            base = int(rank.max()) + 2
            times = max(2, int(62 / math.log2(base)))  # as many ranks as one key holds
            key = rank.copy()
            for i in range(1, times):
                key *= base
                key[: max(0, n - i * depth)] += rank[i * depth :] + 1
            suffixes = np.argsort(key)
            step = key[suffixes]
            depth *= times
            if depth >= deepest:  # the symbols that end zones make all suffixes different
                break
            rank = np.empty(n, np.int64)
            rank[suffixes] = np.concatenate(([0], np.cumsum(step[1:] != step[:-1])))
            levels.append((depth, rank))
        before = text[suffixes - 1]
        heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        self.symbols, self.run_lengths = before[heads], np.diff(np.concatenate((heads, [n])))
        place, neighbour = suffixes[heads], suffixes[heads - 1]
        common = np.zeros(len(heads), np.int64)
        for (depth, rank), times in zip(reversed(levels), self._times(levels, deepest), strict=True):  # the irreducible common prefixes
            for _ in range(times):
                a, b = np.minimum(place + common, n - 1), np.minimum(neighbour + common, n - 1)
                common += depth * ((rank[a] == rank[b]) & (a != b) & (place + common < n) & (neighbour + common < n))
        common[0] = 0
        order = np.argsort(place)
        self.place, self.neighbour, self.common = place[order], neighbour[order], common[order]

    @staticmethod
    def _times(levels: list, deepest: int) -> list[int]:
        """How often each depth, greatest first, fits below the one above it."""
        depths = [deepest, *(x[0] for x in reversed(levels))]
        return [-(-a // b) for a, b in zip(depths, depths[1:], strict=False)]

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the text: its neighbour of lower suffix rank, and how far both match."""
        k = np.zeros(self.n, np.int64)
        k[self.place] = np.arange(len(self.place))
        k = np.maximum.accumulate(k)
        gone = np.arange(self.n) - self.place[k]
        return self.neighbour[k] + gone, self.common[k] - gone

    def repeated(self, length: int) -> np.ndarray:
        """Marks each place whose next length bytes, within its zone, also stand at an earlier place."""
        neighbour, match = self.matches()
        root = np.where(match >= length, neighbour, np.arange(self.n))
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
        first = np.full(self.n, self.n)
        np.minimum.at(first, root, np.arange(self.n))
        return (self.left >= length) & (first[root] < np.arange(self.n))


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turn = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return turn[::2], turn[1::2]


def _ints(parts: list, kind=None) -> pa.Array:
    return pa.array(np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64), kind or pa.int64())


def _sites(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, parts = [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if (found := anchors(as_bytes(text), length, gram)) is not None:
                ids.append(doc)
                parts.append((found[0].view(np.int64), found[1].view(np.int64), found[2], found[3] - found[2], found[4] - found[2]))
        lengths = pa.array(np.concatenate(([0], np.cumsum([len(x[0]) for x in parts]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(lengths, _ints([x[i] for x in parts], pa.int64() if i < 2 else pa.int32())) for i in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], ["doc_id", "h", "z", "first", "width", "place"])


def _split(zone: dict, hashes: Hashes, length: int) -> Iterator[tuple[int, ...]]:
    """The windows of a zone in two, by whether they hold the next bytes after those that all of them hold.

    All windows hold the bytes from at - left to at + right, which the key stands for. Half of what is unknown of a window is
    taken after them; windows that do not reach so far hold as many bytes, and one more, before them. Equal windows
    stand alike to the anchor, so they are on one side and get one key. Rows are as those of sites.
    """
    first, last, left, right = zone["first"], zone["first"] + zone["width"], zone["left"], zone["right"]
    at, unknown = first + zone["place"], length - left - right
    more = (unknown + 1) // 2
    turn = at + right + more - length  # the first window that holds the bytes after
    before = unknown + 1 - more
    for a, b, start, end, l2, r2, side in (
        (max(first, turn), last, at + right, at + right + more, left, right + more, 1),
        (first, min(last, turn - 1), at - left - before, at - left, left + before, right, 2),
    ):
        if a <= b:
            seen = hashes.at(np.array([start, a]), np.array([end, b + length]))
            old = np.array([zone["h"]], np.int64).view(np.uint64)
            key = _scramble(old * _BASE + seen[:1] + np.uint64(side))
            body = _scramble(seen[1:] + np.uint64(at - a) * _BASE)
            yield int(key.view(np.int64)[0]), int(body.view(np.int64)[0]), a, b - a, at - a, l2, r2


_PART = "h long, z long, doc_id long, first int, width int, place int, left int, right int, data binary"


def _zones(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of zones that one index can hold; the halves of others."""
    kinds = [pa.int64()] * 3 + [pa.int32()] * 5 + [pa.binary()]
    names = [x.split()[0] for x in _PART.split(", ")]
    for b in batches:
        out = []
        cols = [b.column(b.schema.get_field_index(x)).to_pylist() for x in ("doc_id", "text", "zones")]
        for doc, text, zones in zip(*cols, strict=True):
            data = as_bytes(text)
            hashes = Hashes(data) if any(z["many"] for z in zones) else None
            for z in zones:
                if z["many"]:
                    out += [(h, body, doc, *rest, None) for h, body, *rest in _split(z, hashes, length)]
                else:
                    out.append((z["h"], None, doc, z["first"], z["width"], None, None, None, data[z["first"] : z["first"] + z["width"] + length]))
        cols = list(zip(*out, strict=True)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _index(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans that repeat within the zones of one gram; rows come sorted by gram, document and place."""
    names = ["doc_id", "first", "last"]

    def search(rows):
        rows = sorted(rows)
        zones = [x[2] for x in rows]
        begin, end = _runs(RunIndex(zones).repeated(length))
        starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in zones])))
        k = np.searchsorted(starts, begin, "right") - 1
        docs, firsts = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])
        return pa.RecordBatch.from_arrays([pa.array(docs[k]), pa.array(firsts[k] + begin - starts[k]), pa.array(firsts[k] + end - 1 - starts[k] + length)], names)

    rows, size, last = [], 0, None
    for b in batches:
        for h, doc, first, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if h != last and size > INDEX:
                yield search(rows)
                rows, size = [], 0
            rows.append((doc, first, data))
            size, last = size + len(data), h
    if rows:
        yield search(rows)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, spans: array of first, last): the bytes covered by strings of length bytes that also start earlier.

    Every window is named by its anchor, and windows can only be equal within the zones of one gram. Zones that are
    copies of an earlier one are spans at once; the distinct zones of a gram are indexed together. The windows of a gram
    with more of them than an index takes are split by the bytes next to it, again and again until an index holds each
    group; once all bytes are known, equal windows are one zone. Every table goes once its last reader has run.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    lists = "h array<long>, z array<long>, first array<int>, width array<int>, place array<int>"
    found = materialize(rows.mapInArrow(lambda it: _sites(it, length, gram), f"doc_id long, {lists}"), "repeats-anchors")
    grams = found.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    grams = materialize(grams, "repeats-grams")
    sites = found.select("doc_id", F.explode(F.arrays_zip("h", "z", "first", "width", "place")).alias("s")).select("doc_id", "s.*")
    sites = salted_lookup(prefilter(sites, ["h"], grams.select("h"), 24), grams, ["h"], "n", ["doc_id", "first"]).drop("n")
    sites = sites.withColumns({"left": F.lit(0), "right": F.lit(gram)})
    sites = from_ = materialize(sites, "repeats-sites", done=(found, grams))
    here, n, spans = F.struct("doc_id", "first"), partitions(docs.sparkSession), []
    while True:
        same = [F.max(c).alias(c) for c in ("width", "place", "left", "right")]  # one value in a zone
        zones = sites.groupBy("h", "z").agg(F.min(here).alias("earliest"), *same, F.count(F.lit(1)).alias("n"))
        zones = materialize(zones, "repeats-zones")
        copies = salted_lookup(sites.select("h", "z", "doc_id", "first"), zones.where("n > 1"), ["h", "z"], "n", ["doc_id", "first"]).where(here > F.col("earliest"))
        copies = copies.select("doc_id", F.col("first").cast("long"), (F.col("first") + F.col("width") + length).cast("long").alias("last"))
        spans.append(materialize(copies, "repeats-copies", done=(from_,)))
        several = zones.groupBy("h").agg(F.count(F.lit(1)).alias("nz")).where("nz > 1")
        open_zones = salted_lookup(zones.select("h", "earliest.*", "width", "place", "left", "right"), several, ["h"], "nz", ["doc_id", "first"])
        open_zones = open_zones.withColumn("many", (F.col("nz") > ZONES) & (F.col("left") + F.col("right") < length)).drop("nz")
        wanted = open_zones.groupBy("doc_id").agg(F.collect_list(F.struct(*(c for c in open_zones.columns if c != "doc_id"))).alias("zones"))
        parts = fetch_texts(docs, wanted).mapInArrow(lambda it: _zones(it, length), _PART)
        parts = from_ = materialize(parts, "repeats-parts", done=(zones,))
        cold = parts.where("data is not null").select("h", "doc_id", F.col("first").cast("long"), "data").repartition(n, "h").sortWithinPartitions("h")
        cold = cold.mapInArrow(lambda it: _index(it, length), "doc_id long, first long, last long")
        spans.append(materialize(cold, "repeats-indexed"))
        sites = parts.where("data is null").drop("data")
        if sites.isEmpty():
            break
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    out = materialize(out.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "repeats-spans", done=spans)
    release(parts)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, gone, runs, left = [], [], [], []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            data, kept, at, removed, n = as_bytes(text), [], 0, 0, 0
            for first, last in sorted((x["first"], x["last"]) for x in spans or ()):
                if first > at or not n:
                    kept.append(data[at:first])
                    n += 1
                    at = first
                removed += max(0, last - at)
                at = max(at, last)
            sizes.append(len(data))
            gone.append(removed)
            runs.append(n)
            left.append(b"".join([*kept, data[at:]]))
        cols = [pa.array(x, pa.int64()) for x in (sizes, gone, runs)]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: binary) of each row of docs (doc_id, text), as UTF-8 bytes.

    A byte goes if a string of length bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the
    same document, judged on the input. Null text is empty; texts shorter than length and rows of null doc_id stay
    whole; rows that repeat a doc_id count as at the same place. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeated_spans(docs, length, gram)
    near = maybe_in(docs, ["doc_id"], bitmap(spans, ["doc_id"], 22), 22)
    hit = near.where("_maybe").drop("_maybe").join(spans.hint("shuffle_hash"), "doc_id", "left")
    rest = near.where("not _maybe").drop("_maybe").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return hit.unionByName(rest).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def kept_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
