"""Exact Jaccard join on word shingles: T-occurrence search (DivideSkip) inside bounded blocks, then components."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, connected_components, fetch_texts, materialize, maybe_in, prefilter, release, salted_lookup

#: Similarity 80 of 100, shingles of five words.
PERCENT, WORDS = 80, 5
#: The members of all sets that are searched in one block, about; larger groups are cut into chunks.
BLOCK = 1 << 15
#: Blocks of the last search are as many times larger, as each set of a wide group is copied to all its chunks.
WIDER = 4
#: Multipliers of the independent minimum hashes that gather near copies first.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Keys of the two word hashes, and the weights of the words of a shingle in each.
KEY = 0x5851F42D4C957F2D
_KEYS = [np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35, 0xD1342543DE82EF95, 0xA0761D6478BD642F)]
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_WEIGHT = np.random.default_rng(20240607).integers(1, 2**63, (2, 16), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Sets of a chunk, about, if they are small.
SETS = 256
#: Characters hashed in one go, about.
BATCH = 1 << 18


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _mixed(word: np.ndarray, k: int, weights: np.ndarray) -> np.ndarray:
    """A hash of each k consecutive of the word hashes."""
    full = np.full(max(0, len(word) - k + 1), np.uint64(k))
    for i in range(k):
        full = full + word[i : i + len(full)] * weights[i % len(weights)]
        if i % len(weights) == len(weights) - 1:
            full = _scramble(full)
    return _scramble(full)


def _words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word of all texts, and the first word of each text, and of none.

    The first 16 bytes of a word are taken whole; a longer word is first hashed to 128 bits under a key.
    """
    data = b"\n" + b"\n".join(raws).translate(_FOLD) + b"\n" + bytes(16)
    low = np.frombuffer(data, np.uint8)
    white = _WHITE[low[:-16]]
    turn = np.flatnonzero(white[1:] != white[:-1]) + 1
    begin, end = turn[::2], turn[1::2]  # white space stands before and after, so each word has both
    n = end - begin
    eight = np.lib.stride_tricks.sliding_window_view(low, 8)
    low, high = eight[begin].view("<u8")[:, 0] & _MASK[np.minimum(n, 8)], eight[begin + 8].view("<u8")[:, 0] & _MASK[np.clip(n - 8, 0, 8)]
    for i in np.flatnonzero(n > 16).tolist():
        low[i], high[i] = np.frombuffer(xxhash.xxh3_128_digest(data[begin[i] : end[i]], KEY), np.uint64)
    n = n.astype(np.uint64)
    first = _scramble(_scramble(low ^ _KEYS[0]) + _scramble(high + n * _KEYS[1]))
    second = _scramble(_scramble(low + _KEYS[2]) ^ _scramble(high * _KEYS[3] + n))
    return first, second, np.searchsorted(begin, np.cumsum([1, *(len(x) + 1 for x in raws)]))


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles, and the least and greatest of as many second
    hashes; one shingle for all its words if it has fewer.

    Each half of a shingle is a weighted sum of the like halves of its words.
    """
    *halves, first = _words([(x or "").encode("utf-8", "surrogatepass") for x in texts])
    full = [_mixed(x, k, w) for x, w in zip(halves, _WEIGHT, strict=True)]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            own, more = np.sort(full[0][a : b - k + 1]), full[1][a : b - k + 1]
            fresh = own[1:] != own[:-1]
            out.append((own if fresh.all() else own[np.concatenate(([True], fresh))], np.array([more.min(), more.max()])))
        else:
            out.append(tuple(_mixed(x[a:b], b - a, w) if b > a else np.empty(0, np.uint64) for x, w in zip(halves, _WEIGHT, strict=True)))
    return out


def batched_sets(texts: list[str | None], k: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """shingle_sets() of about BATCH characters at a time."""
    some, size = [], 0
    for x in texts:
        some.append(x)
        size += len(x or "") + 1
        if size >= BATCH:
            yield from shingle_sets(some, k)
            some, size = [], 0
    if some:
        yield from shingle_sets(some, k)


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    return shingle_sets([text], k)[0][0]


def signature(found: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """128 bits of BLAKE2 over all members and the ends of their second hashes: sets are equal if their signatures are."""
    found = hashlib.blake2b(found[0].tobytes() + found[1].tobytes(), digest_size=16).digest()
    return tuple(int.from_bytes(found[i : i + 8], "little", signed=True) for i in (0, 8))


def need(n: int, m: int, percent: int = PERCENT) -> int:
    """The least overlap of sets of n and m members with 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def least(n: int, percent: int = PERCENT) -> int:
    """The least overlap that a set of n members has with any partner."""
    return -(-percent * n // 100)


def extra(n: int) -> int:
    """How many common members the prefix of a set of n members is to show."""
    return max(1, n // 20)


class Searcher:
    """Inverted lists over added sets; search() is DivideSkip: heap-merge the short lists, binary-probe the long ones.

    The cost of a search follows the lists of its own members, not the number of sets added.
    """

    def __init__(self, percent: int = PERCENT):
        self.percent, self.lists, self.sizes = percent, {}, []

    def add(self, members: list[int]) -> int:
        k = len(self.sizes)
        self.sizes.append(len(members))
        for x in members:
            self.lists.setdefault(x, []).append(k)
        return k

    @staticmethod
    def merge(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
        """(set, lists that hold it) of each set in at least that many of the ascending lists.

        The heap holds the next entry of each list. If the smallest entry is too rare, as many more lists are taken off
        as could not make up for it, and all of them skip to the entry that is then smallest.
        """
        many = len(lists)
        heap = [x[0] * many + i for i, x in enumerate(lists)]
        heapify(heap)
        at = [0] * many
        while len(heap) >= least:
            top, taken = heap[0] // many, []
            while heap and heap[0] // many == top:
                taken.append(heappop(heap) % many)
            if len(taken) >= least:
                yield top, len(taken)
                to = top + 1
            else:
                while len(taken) < least - 1 and heap:
                    taken.append(heappop(heap) % many)
                if not heap:
                    return
                to = heap[0] // many
            for i in taken:
                own = lists[i]
                at[i] = bisect_left(own, to, at[i])
                if at[i] < len(own):
                    heappush(heap, own[at[i]] * many + i)

    @staticmethod
    def divide(lengths: list[int], t: int) -> int:
        """How many lists, by ascending length, are merged if sets in t of them are sought; the others are probed.

        Merging costs the entries of the short lists; at most every (t - long)-th of them is a candidate, and 64 probes of
        long lists take about the time of an entry.
        """
        entries, best = [0, *accumulate(lengths)], (math.inf, 0)
        spare = 1
        while True:
            spare = min(spare, t)
            short = len(lengths) - t + spare
            cost = entries[short] * (1 + math.log2(short) / 4) + entries[short] / spare * (2 + (t - spare) / 64)
            best = min(best, (cost, short))
            if spare == t:
                return best[1]
            spare *= 2

    @staticmethod
    def probe(some: list[tuple[int, int]], long: list[list[int]], t: int) -> list[tuple[int, int]]:
        """The candidates (set, lists that hold it) that reach t with the long lists, which are searched for them by halving.

        All are sought at once in the lists laid end to end, unless the candidates are too few for that. One ends when the
        lists to come cannot bring it to t.
        """
        n, total, out = len(long), sum(map(len, long)), []
        if n * len(some) < max(4096, total // 8):
            for x, count in some:
                for left, own in zip(range(n, 0, -1), long, strict=True):
                    if count + left < t:
                        break
                    at = bisect_left(own, x)
                    count += at < len(own) and own[at] == x
                out.append((x, count))
            return [x for x in out if x[1] >= t]
        if not n:
            return [x for x in some if x[1] >= t]
        ids, counts = (np.array(x) for x in zip(*some, strict=True))
        width = max(some[-1][0], *(x[-1] for x in long)) + 1
        flat = np.fromiter(chain.from_iterable(long), np.int64, total) + np.repeat(np.arange(n) * width, [len(x) for x in long])
        at = 0
        while at < n and len(ids):
            to = min(n, at + max(1, min(-(-n // 4), (1 << 18) // len(ids))))
            keys = np.arange(at, to)[:, None] * width + ids
            counts = counts + (flat[np.minimum(np.searchsorted(flat, keys), total - 1)] == keys).sum(0)
            alive = counts + (n - to) >= t
            ids, counts, at = ids[alive], counts[alive], to
        return list(zip(ids.tolist(), counts.tolist(), strict=True))

    def search(self, members: list[int], wanted: Callable[[int], bool] = lambda x: True) -> list[int]:
        """Indexes of all added sets that link to this one and are wanted, ascending."""
        n, sizes, percent = len(members), self.sizes, self.percent
        t = least(n, percent)
        found = [x for x in map(self.lists.get, members) if x]
        if len(found) < t or not t:
            return []
        found.sort(key=len)
        at = self.divide([len(x) for x in found], t)
        short, long = found[:at], found[at:]
        some = [x for x in self.merge(short, t - len(long)) if percent * sizes[x[0]] <= 100 * n and percent * n <= 100 * sizes[x[0]] and wanted(x[0])]
        return [x for x, count in self.probe(some, long, t) if 100 * count >= percent * (n + sizes[x] - count)] if some else []


def _central(sets: list[np.ndarray]) -> np.ndarray:
    """An order of sets: those first whose members the most sets of the block hold, on average."""
    _, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    lengths = np.array([len(x) for x in sets])
    return np.argsort(-np.add.reduceat(counts[which], np.cumsum(lengths) - lengths) / lengths, kind="stable")


def _leaders(sets: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """A forest of links: each set is searched among the leaders, those that linked to none before; a leader is given as a
    link to itself. The sets in the middle of a group of copies come first, so most of the group has one leader."""
    if not sets:
        return []
    index, ids, out = Searcher(percent), [], []
    for i in _central([x for _, x in sets]).tolist():
        sig, members = sets[i][0], sets[i][1].tolist()
        links = index.search(members)
        out += [(sig, ids[x]) for x in links]
        if not links:
            index.add(members)
            ids.append(sig)
            out.append((sig, sig))
    return out


def _across(sets: list[tuple[int, list[int], int, int]], percent: int, sides: bool) -> list[tuple[int, int]]:
    """Links between sets (sig, members, comp, side) of different components, enough to join all components that link in this
    block; with sides, of links between the two sides of a block pair.

    A set is searched among those of the components before its own, with sides those on the other side. The component of
    the most sets comes first, so that these are added only: no list then holds sets that cannot count, as most of a large
    group of copies are one component.
    """
    index, ids, out, parent = [Searcher(percent) for _ in range(2)], ([], []), [], {}
    comps: dict[int, list[tuple[int, list[int], int]]] = {}
    for sig, members, comp, side in sets:
        comps.setdefault(comp, []).append((sig, members, side if sides else 0))

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for comp, own in sorted(comps.items(), key=lambda x: -len(x[1])):
        for sig, members, side in own:
            there = 1 - side if sides else 0
            for x in index[there].search(members, lambda x: root(ids[there][x][1]) != root(comp)):  # noqa: B023
                other, theirs = ids[there][x]
                if root(theirs) != root(comp):
                    out.append((sig, other))
                    parent[root(theirs)] = root(comp)
        for sig, members, side in own:
            index[side].add(members)
            ids[side].append((sig, comp))
    return out


def _longs(parts: list[np.ndarray]) -> pa.ListArray:
    lengths = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([*parts, np.empty(0, np.int64)]), pa.int64()))


def _prints(batches: Iterator[pa.RecordBatch], percent: int, k: int) -> Iterator[pa.RecordBatch]:
    names = ["n", "s1", "s2", "prefix", "keys"]
    for b in batches:
        at = b.schema.get_field_index("text")
        sizes, sigs, prefixes, keys = [], [], [], []
        for found in batched_sets(b.column(at).to_pylist(), k):
            own, n = found[0], len(found[0])
            sizes.append(n)
            sigs.append(signature(found) if n else (None, None))
            prefixes.append(own[: n - least(n, percent) + extra(n)].view(np.int64) if n else np.empty(0, np.int64))
            keys.append([int((own * m >> np.uint64(1)).min()) for m in _MIX] if n else [])
        rest = [i for i in range(b.num_columns) if i != at]
        cols = [pa.array(sizes, pa.int64()), *(pa.array([x[i] for x in sigs], pa.int64()) for i in (0, 1)), _longs(prefixes), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), *cols], [*(b.schema.names[i] for i in rest), *names])


def _sets(k: int, columns: list[str]):
    """columns and members of rows (rk, text, s1, s2, columns) whose text has that signature; others only share the rk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a few rows at a time, as sets take more room than texts
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                col = {x: part.column(part.schema.get_field_index(x)) for x in ("text", "s1", "s2", *columns)}
                found = list(batched_sets(col["text"].to_pylist(), k))
                own = [i for i, (x, *sig) in enumerate(zip(found, col["s1"].to_pylist(), col["s2"].to_pylist(), strict=True)) if signature(x) == tuple(sig)]
                yield pa.RecordBatch.from_arrays([*(col[c].take(pa.array(own, pa.int64())) for c in columns), _longs([found[i][0].view(np.int64) for i in own])], [*columns, "members"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], search) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; search(rows of one block) gives links."""

    def links(block: int | None, rows: list) -> pa.RecordBatch:
        found = search(rows)
        cols = [pa.array([block] * len(found), pa.int64()), *(pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))]
        return pa.RecordBatch.from_arrays(cols, ["block", "u", "v"])

    block, rows = None, []
    for b in batches:
        names = b.schema.names
        cols = {x: b.column(i) for i, x in enumerate(names)}
        meta = [cols[x].to_pylist() for x in names if x not in ("block", "members")]
        out = []
        for i, own in enumerate(cols["block"].to_pylist()):
            if own != block:
                out.append(links(block, rows))
                block, rows = own, []
            rows.append((*(x[i] for x in meta), cols["members"][i].values.to_numpy()))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
    yield links(block, rows)


def _search(blocks: DataFrame, search: Callable) -> DataFrame:
    """(block, u, v): the links found in each block. No number of partitions is given, so that adaptive execution joins
    those that hold few blocks."""
    dealt = blocks.repartition("block").sortWithinPartitions("block", F.size("members"), "sig")
    return dealt.mapInArrow(lambda it: _blocks(it, search), "block long, u long, v long")


def row_key(docs: DataFrame) -> DataFrame:
    """docs with rk, by which a text is found again: the doc_id, or a hash of the text of a row without one."""
    return docs.withColumn("rk", F.coalesce(F.col("doc_id"), F.xxhash64("text")))


def prints(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """docs without text, plus (n, s1, s2, prefix, keys): set size, set signature, smallest members, minimum hashes."""
    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(lambda it: _prints(it, percent, k), f"{rest}, n long, s1 long, s2 long, prefix array<long>, keys array<long>")


def named(own: DataFrame) -> DataFrame:
    """own with sig, one long for each signature: its first half, but a hash of both where that half is seen to serve two."""
    clash = own.groupBy("s1").agg(F.min("s2").alias("a"), F.max("s2").alias("b")).where("a < b")
    words = materialize(bitmap(clash, ["s1"], 16), "jaccard-clash")
    if words.isEmpty():
        return own.withColumn("sig", F.col("s1"))
    return maybe_in(own, ["s1"], words, 16).withColumn("sig", F.when(F.col("_maybe"), F.xxhash64("s1", "s2")).otherwise(F.col("s1"))).drop("_maybe")


def gather_copies(docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) between sets that share a minimum hash, found by searching blocks of such sets.

    In a group cut into chunks, the leaders of all chunks meet again in new chunks, until a round is of no use.
    """
    keyed, links, count = reps.select("sig", "s1", "s2", "rk", "n", F.posexplode("keys").alias("k", "key")), None, None
    for turn in range(64):
        shared = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")).where("rows > 1")
        shared = materialize(shared, "jaccard-shared")
        rows = salted_lookup(prefilter(keyed, ["k", "key"], shared), shared, ["k", "key"], "rows", ["sig"])
        rows = rows.withColumn("q", F.ceil(F.greatest(F.col("total") / BLOCK, F.col("rows") / SETS)))
        chunk = F.pmod(F.xxhash64(F.lit(turn), "sig", "k"), F.col("q"))
        rows = rows.withColumn("block", F.xxhash64("k", "key", chunk))
        wanted = rows.groupBy("rk", "sig", "s1", "s2").agg(F.collect_list("block").alias("blocks"))
        sets = fetch_texts(docs, wanted, "rk").mapInArrow(_sets(k, ["sig", "blocks"]), "sig long, blocks array<long>, members array<long>")
        found = materialize(_search(sets.select("sig", "members", F.explode("blocks").alias("block")), lambda rows: _leaders(rows, percent)), "jaccard-near")
        links = found if links is None else links.unionByName(found)
        leaders = found.where("u = v").select(F.col("u").alias("sig"), "block")
        again = rows.where("q > 1").select("sig", "s1", "s2", "rk", "n", "k", "key", "block").join(leaders, ["sig", "block"], "left_semi")
        keyed = materialize(again.drop("block"), "jaccard-again")
        before, count = count, keyed.count()
        if not count or (before is not None and count > 0.5 * before):
            break
    return links.select("u", "v").where("u <> v")


def _apart(rows: DataFrame) -> DataFrame:
    """Those rows (h, sig, comp, ...) whose member h also occurs in another component."""
    several = rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("df")).where("lo < hi").select("h", "df")
    several = materialize(several, "jaccard-apart")
    return salted_lookup(prefilter(rows, ["h"], several.select("h"), 24), several, ["h"], "df", ["sig"])


def _covered(sets: DataFrame, percent: int) -> DataFrame:
    """Drops sets of which certainly too few members occur in another set: a bitmap of the members that do counts at
    least those, so no partner is lost, and only one row a set is shuffled for the count."""
    rows = sets.select("sig", "n", F.explode("members").alias("h"))
    twice = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("h")
    seen = maybe_in(rows, ["h"], bitmap(twice, ["h"], 24), 24).groupBy("sig", "n").agg(F.sum(F.col("_maybe").cast("long")).alias("c"))
    enough = materialize(seen.where(F.expr(f"100 * c >= {percent} * n")).select("sig"), "jaccard-enough")
    return materialize(prefilter(sets, ["sig"], enough).join(enough, "sig", "left_semi"), "jaccard-covered", done=(sets, enough))


def _dealt(rare: DataFrame, groups: DataFrame) -> DataFrame:
    """(sig, block, side, pair): the blocks in which each set of groups (sig, n, grp) is searched.

    A group is a block, or so many chunks of which every two meet. If that copies its sets more often than they have rare
    members (h, sig), they are dealt by these instead, as a linked pair shares one; then only the sets of one rare member
    can need chunks, and a set is copied as often as it has rare members, whatever the size of the group.
    """

    def sized(rows: DataFrame, keys: list[str]) -> DataFrame:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("rares")).alias("copies"))
        return salted_lookup(rows, sizes, keys, "size", ["sig"]).drop("size").withColumn("q", F.ceil(F.col("total") / (WIDER * BLOCK)).cast("int"))

    rares = rare.groupBy("sig").agg(F.count(F.lit(1)).alias("rares"))
    rows = sized(groups.join(rares, "sig"), ["grp"])
    few = F.col("q") * F.col("total") <= F.col("copies")
    whole = rows.where((F.col("q") == 1) | few).withColumn("h", F.lit(0).cast("long"))
    wide = rows.where((F.col("q") > 1) & ~few).select("sig", "n", "grp", "rares").join(rare, "sig")
    placed = whole.unionByName(sized(wide, ["grp", "h"]))
    placed = placed.withColumn("c", F.pmod(F.xxhash64("sig"), F.col("q")).cast("int")).withColumn("o", F.explode(F.expr("sequence(0, q - 1)")))
    block = F.xxhash64("grp", "h", F.least("c", "o"), F.greatest("c", "o"))
    return placed.select("sig", block.alias("block"), (F.col("c") <= F.col("o")).cast("int").alias("side"), (F.col("c") != F.col("o")).alias("pair"))


def search_rest(docs: DataFrame, own: DataFrame, reps: DataFrame, comps: DataFrame, percent: int, k: int) -> DataFrame:
    """Links between different components: none is lost.

    A linked pair shares at least extra() members of its prefixes and least() of its sets, so sets with fewer members that
    another component has are out. Those left are searched in blocks: components of the graph of sets and their rarest
    common members, so that a common passage joins none.
    """
    posts = own.select("sig", "n", F.explode("prefix").alias("h"))
    several = materialize(posts.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "jaccard-lists")
    posts = salted_lookup(prefilter(posts, ["h"], several.select("h"), 24), several, ["h"], "df", ["sig"]).select("h", "sig", "n").distinct()
    names = comps.withColumnRenamed("node", "sig")
    label = F.coalesce("comp", "sig").alias("comp")
    posts = materialize(posts.join(names, "sig", "left").select("h", "sig", "n", label), "jaccard-prefixes", done=(several,))
    floor = F.expr(f"greatest(1L, cast(ceil({percent} * n / 100) as long) div 20)")
    left = _apart(posts).groupBy("sig", "n", "comp").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= floor)
    left = materialize(left.select("sig", "comp").join(reps.select("sig", "s1", "s2", "rk", "n"), "sig"), "jaccard-left", done=(posts,))
    sets = fetch_texts(docs, left, "rk").mapInArrow(_sets(k, ["sig", "n", "comp"]), "sig long, n long, comp long, members array<long>").dropDuplicates(["sig"])
    sets = _covered(materialize(sets, "jaccard-sets", done=(left,)), percent)
    full = _apart(sets.select("sig", "n", "comp", F.explode("members").alias("h"))).select("h", "sig", "n", "df")
    full = materialize(full, "jaccard-full")
    enough = full.groupBy("sig", "n").agg(F.count(F.lit(1)).alias("c")).where(F.expr(f"100 * c >= {percent} * n")).drop("n")
    # rarest members first: a pair shares one of those that are left once least() - 1 have been taken off the end
    by = Window.partitionBy("sig").orderBy("df", "h")
    rare = full.join(enough, "sig").withColumn("at", F.row_number().over(by))
    rare = rare.where(F.expr(f"at <= c - cast(ceil({percent} * n / 100) as long) + 1")).select("h", "sig")
    rare = materialize(rare, "jaccard-rare", done=(full,))
    hubs = rare.groupBy("h").agg(F.min("sig").alias("hub"), F.count(F.lit(1)).alias("df"))
    groups = connected_components(salted_lookup(rare, hubs, ["h"], "df", ["sig"]).select(F.col("sig").alias("u"), F.col("hub").alias("v")), "jaccard-blocks")
    placed = _dealt(rare, groups.toDF("sig", "grp").join(sets.select("sig", "n"), "sig"))
    rows = sets.join(placed, "sig").select("sig", "comp", "side", "pair", "members", "block")

    def search(rows):
        return _across([(sig, x.tolist(), comp, side) for sig, comp, side, _, x in rows], percent, bool(rows) and rows[0][3])

    return materialize(_search(rows, search).select("u", "v"), "jaccard-rest", done=(sets, rare, groups))


def jaccard_rows(docs: DataFrame, carry: Sequence[str] = (), percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """(carry, doc_id, n_shingles, component_id, comp) of each row of docs (doc_id, text, carry): jaccard_components() with
    columns that go along, their names none of its own, and the component itself: null for a set without members."""
    docs = row_key(docs.select(*carry, F.col("doc_id").cast("long").alias("doc_id"), "text"))
    own = materialize(prints(docs, percent, k), "jaccard-prints")
    some = named(own.where("s1 is not null"))
    best = [F.min_by(c, "rk").alias(c) for c in ("s1", "s2", "n", "keys")]
    reps = materialize(some.groupBy("sig").agg(F.min("rk").alias("rk"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_rows"), *best), "jaccard-sigs")
    texts = docs.select("rk", "text")
    near = gather_copies(texts, reps, k, percent)
    comps = connected_components(near, "jaccard-comps")
    rest = search_rest(texts, some, reps, comps, percent, k)
    release(comps)
    comps = connected_components(near.unionByName(rest), "jaccard-comps")
    sigs = reps.select("sig", "first", "n_rows").join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    firsts = sigs.groupBy("comp").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n_sigs"))
    sigs = materialize(salted_lookup(sigs, firsts, ["comp"], "n_sigs", ["sig"]).select("sig", "comp", "component_id", "n_rows"), "jaccard-names", done=(reps, comps))
    found = salted_lookup(some.select(*carry, "doc_id", "rk", "n", "sig"), sigs, ["sig"], "n_rows", ["rk"])
    columns = [*carry, "doc_id", F.col("n").alias("n_shingles")]
    none = own.where("s1 is null").select(*columns, F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("comp"))
    return found.select(*columns, "component_id", "comp").unionByName(none)


def jaccard_components(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row (doc_id, text): near-duplicate components, exact.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct k-word shingles, or
    the whole sequence if shorter. Two documents link at 100 * intersection >= percent * union; component_id is the
    smallest doc_id reachable. Null, empty and blank texts have 0 shingles and their own component. Equal sets are one
    class, so copies are never expanded into pairs; rows that share a doc_id are judged each by its own text, and a row of
    null doc_id links like others: its component_id is null if no row of its component has an id. Other columns are
    ignored. Words are hashed whole, twice to 64 bits under keys; sets are equal if their 128-bit signatures are, and
    overlaps of unequal sets are counted by the first hashes of their members.
    """
    return jaccard_rows(docs, (), percent, k).drop("comp")


QUERY_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
