import hashlib
import random

import numpy as np
import pytest

from tarnlink.llm.exact_dedup import exact_dedup, normalise
from tarnlink.llm.line_dedup import line_dedup
from tarnlink.llm.ngram_join import Searcher, _across, jaccard_components, need, shingles
from tarnlink.llm.suffix_dedup import RunIndex, kept_digest, remove_repeats

WORDS = ["ab", "the", "thé", "x", "Quux", "na", "ion", "ß", "漢字", "z9"]


def corpus(seed=1, n=60):
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(k))
    passages = [say(r.randrange(12, 40)) for _ in range(4)]
    texts = [None, "", " \n\t", "short", "four words are here", "Four  words are here"]
    while len(texts) < n:
        t = say(r.randrange(1, 120))
        kind = r.random()
        if kind < 0.25 and len(texts) > 8:
            t = texts[r.randrange(6, len(texts))]
            w = t.split(" ")
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            t = " ".join(w)
        elif kind < 0.5:
            t = say(r.randrange(0, 30)) + " " + r.choice(passages) + "\n" + say(r.randrange(0, 30))
        elif kind < 0.6:
            t = r.choice(passages) + " " + r.choice(passages)
        texts.append(t)
    texts.append("ab " * 400)
    texts.append(say(5000))
    ids = list(range(0, 3 * len(texts), 3))
    r.shuffle(ids)
    return list(zip(ids, texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", t, 7) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n string, h int").repartition(3)


EMPTY = "doc_id long, text string, lang string"


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2048, 3, 1])
def test_remove_repeats_is_brute_force(spark, docs, monkeypatch, hot):
    monkeypatch.setattr("tarnlink.llm.suffix_dedup.ZONES", hot)
    if hot == 1:
        monkeypatch.setattr("tarnlink.llm.common.HOT_ROWS", 1)
    got = {r[0]: tuple(r)[1:] for r in kept_digest(remove_repeats(docs)).collect()}
    assert got == brute_repeats([(r.doc_id, r.text) for r in docs.collect()], 100)
    assert sum(x[1] for x in got.values()) > 1000


def test_run_index_matches_brute_force():
    r = np.random.default_rng(3)
    for _ in range(30):
        zones = [bytes(r.integers(97, 99, int(r.integers(1, 40)), dtype=np.uint8)) for _ in range(int(r.integers(1, 12)))]
        index = RunIndex(zones)
        assert index.run_lengths.sum() == sum(map(len, zones)) + len(zones)
        seen, want = set(), []
        for z in zones:
            for p in range(len(z) + 1):
                w = z[p : p + 6]
                want.append(len(w) == 6 and w in seen)
                seen.add(w)
        assert index.repeated(6).tolist() == want


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_jaccard_components_are_brute_force(spark, docs, monkeypatch, size):
    monkeypatch.setattr("tarnlink.llm.ngram_join.BLOCK", size)
    got = {r[0]: tuple(r)[1:] for r in jaccard_components(docs).collect()}
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want
    assert len({c for _, c in got.values()}) < len(got) - 4


@pytest.mark.parametrize("size", [1 << 20, 400, 30])
def test_exact_level_finds_what_gathering_missed(spark, docs, monkeypatch, size):
    monkeypatch.setattr("tarnlink.llm.ngram_join.BLOCK", size)
    monkeypatch.setattr("tarnlink.llm.ngram_join._leaders", lambda sets, percent: [])
    got = {r[0]: tuple(r)[1:] for r in jaccard_components(docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_words_that_polynomials_confuse_and_odd_ids(spark):
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, word), (2, other), (None, long), (7, long + " more"), (7, "else here"), (None, "alone it is"), (None, None), (9, "else here"), (8, "alone it was"), (8, "alone it was")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == sorted([(1, 1, 1), (2, 1, 2), (None, 56, 7), (7, 57, 7), (7, 1, 7), (None, 1, None), (None, 0, None), (9, 1, 7), (8, 1, 8), (8, 1, 8)], key=str)


def test_merge_skips_no_set():
    r = random.Random(8)
    for _ in range(200):
        lists = [sorted(r.sample(range(40), r.randrange(1, 30))) for _ in range(r.randrange(1, 12))]
        for least in range(1, len(lists) + 1):
            want = [(x, n) for x in range(40) if (n := sum(x in own for own in lists)) >= least]
            assert list(Searcher.merge(lists, least)) == want


def test_searcher_is_exact():
    r = random.Random(5)
    sets = [sorted(r.sample(range(30), r.randrange(1, 24))) for _ in range(300)]
    index = Searcher(60)
    for i, s in enumerate(sets):
        want = [j for j in range(i) if 100 * len(set(s) & set(sets[j])) >= 60 * len(set(s) | set(sets[j]))]
        assert index.search(s) == want
        index.add(s)
    assert need(10, 10) == 9 and len(shingles("a b c d e f")) == 2 and len(shingles("A  b")) == 1


@pytest.mark.parametrize("sides", [False, True])
def test_sets_of_one_component_are_not_searched_among_their_own(monkeypatch, sides):
    r = random.Random(3)
    base = r.sample(range(2000), 60)
    sets = []
    for i in range(120):
        own = set(base)
        for _ in range(r.randrange(1, 12)):
            own.discard(r.choice(base))
            own.add(r.randrange(2000))
        sets.append((i, sorted(own), 0 if i < 100 else i, i % 2))
    links = {(i, j) for i, x, a, s in sets for j, y, b, t in sets if a != b and not (sides and s == t) and 100 * len({*x} & {*y}) >= 80 * len({*x} | {*y})}
    searched, search = [], Searcher.search

    def counted(self, members, wanted=lambda x: True):
        searched.append(len(self.sizes))
        return search(self, members, wanted)

    def joined(pairs):
        at = list(range(120))
        for _ in at:
            for i, j in pairs:
                a, b = (0 if x < 100 else x for x in (i, j))
                at[a] = at[b] = min(at[a], at[b])
        return at

    monkeypatch.setattr(Searcher, "search", counted)
    found = _across(sets, 80, sides)
    assert links.issuperset(found) and joined(found) == joined(links) != list(range(120))
    assert sum(x > 0 for x in searched) == 20 and max(searched) <= (60 if sides else 119)


def test_probes_of_few_and_of_many_are_the_same():
    r = random.Random(4)
    for _ in range(200):
        long = [sorted(r.sample(range(400), r.randrange(1, 400))) for _ in range(r.choice([0, 5, 40, 200]))]
        some = [(x, r.randrange(1, 4)) for x in sorted(r.sample(range(420), r.randrange(1, 60)))]
        t = r.randrange(1, 4 + len(long))
        want = [(x, m) for x, c in some if (m := c + sum(x in own for own in long)) >= t]
        assert Searcher.probe(some, long, t) == want
        assert [y for x in some for y in Searcher.probe([x], long, t)] == want


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normalise(t), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k).hexdigest()) for k, g in groups.items() for _, i in g}


@pytest.mark.parametrize("digest", [None, lambda data: str(len(data) % 3)])
def test_exact_dedup_is_brute_force(spark, docs, tmp_path, digest):
    docs.write.parquet(str(tmp_path / "d.parquet"))
    got = exact_dedup(spark, str(tmp_path / "d.parquet"), *([digest] if digest else []))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()}
    assert got == brute_exact([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("digest", [None, lambda data: "x", lambda data: str(len(data) % 3)])
def test_exact_dedup_of_null_and_repeated_ids(spark, tmp_path, digest):
    rows = [(None, "a b"), (None, "zz"), (3, "ab"), (3, "other"), (3, "other"), (5, "a  b"), (6, None), (None, ""), (9, "a\tb\n"), (1, "oth er")]
    spark.createDataFrame([(i, t, 1, t) for i, t in rows], "doc_id long, text string, digest int, locator string").repartition(2).write.parquet(str(tmp_path / "d.parquet"))
    got = exact_dedup(spark, str(tmp_path / "d.parquet"), *([digest] if digest else [])).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ab, other = (4, sha(b"ab")), (3, sha(b"other"))
    want = [(None, 5, *ab), (3, 5, *ab), (5, 5, *ab), (9, 5, *ab), (3, 1, *other), (3, 1, *other), (1, 1, *other), (None, None, 1, sha(b"zz")), (6, 6, 2, sha(b"")), (None, 6, 2, sha(b""))]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def brute_lines(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        ls = (t or "").split("\n")
        gone = set()
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i] = (None if t is None else "\n".join(x for p, x in enumerate(ls) if p not in gone), len(gone))
    return out


def test_line_dedup_is_brute_force(spark):
    r = random.Random(2)
    rows = [(i, "\n".join(r.choice("abc") for _ in range(r.randrange(0, 12)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n\n"), (104, "x\r\ny\nz" * 3000)]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, lang string, pos int")
    got = line_dedup(df)
    assert got.columns == ["doc_id", "text", "lang", "pos", "n_lines", "n_removed"]
    assert {x.doc_id: (x.text, x.n_removed) for x in got.collect()} == brute_lines(rows)


def test_line_dedup_with_clashing_names_and_repeated_ids(spark):
    names = ["_mask", "_word", "_bit", "_maybe", "_at", "at", "t", "a.b", "c0", "h1", "pos", "n", "_salt", "x`y"]
    rows = [(1, "a\nb\nc\nd"), (2, "z\na\nb\nc"), (2, "q\nb\nc\nd"), (2, "q\nb\nc\nd"), (None, "a\nb\nc")]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], ["doc_id", "text", *names])
    got = line_dedup(df)
    assert got.columns == ["doc_id", "text", *names, "n_lines", "n_removed"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert [(r[0], r[1], r[-1]) for r in got] == sorted([(1, "a\nb\nc\nd", 0), (2, "q", 3), (2, "q", 3), (2, "z", 3), (None, "a\nb\nc", 0)], key=str)
    assert all(r[2:-2] == tuple(range(len(names))) for r in got)


def test_empty_tables_and_null_ids(spark, tmp_path):
    empty = spark.createDataFrame([], EMPTY)
    empty.write.parquet(str(tmp_path / "e.parquet"))
    assert exact_dedup(spark, str(tmp_path / "e.parquet")).count() == 0
    for f in (line_dedup, jaccard_components, remove_repeats):
        assert f(empty).count() == 0
    odd = spark.createDataFrame([(None, "a\nb\nc\na\nb\nc", None), (4, "a\nb\nc", "x"), (4, "a\nb\nc", "x")], EMPTY)
    odd.write.parquet(str(tmp_path / "o.parquet"))
    assert sorted((r.doc_id or 0, r.group_size) for r in exact_dedup(spark, str(tmp_path / "o.parquet")).collect()) == [(0, 1), (4, 2), (4, 2)]
    assert sorted(r.n_removed for r in line_dedup(odd).collect()) == [0, 0, 0]
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard_components(odd).collect()) == [(0, None), (4, 4), (4, 4)]
    assert remove_repeats(odd).count() == 3
