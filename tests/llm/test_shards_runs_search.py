"""K-d sharding, periodic runs and best-position search against brute force; defined results."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from finelens.llm import best_position as B
from finelens.llm import kd_shards as K
from finelens.llm import periodic_runs as P

from . import brute

# ---------------------------------------------------------------- k-d sharding

#: Extra columns named like columns that the operators use inside.
CLASH = "id long, size long, shard int, __node int, __id long, row_in string, runs int, n long, terms string, `a.b` int"


def documents(spark, rows, parts=3):
    """rows: (doc_id, text, lang, source)."""
    data = [(*r, 1, 2, 3, 4, 5, "x", 6, 7, "y", 8) for r in rows]
    schema = f"doc_id long, text string, lang string, source string, {CLASH}"
    return spark.createDataFrame(data, schema).repartition(parts)


def coordinate(s):
    return int((s or "").encode()[: K.STRING_BYTES].ljust(K.STRING_BYTES, b"\0").hex(), 16)


def tree_twin(rows, shards):
    """Index of a row -> shard: sorts every node whole."""
    pts = []
    for i, (doc_id, text, lang, source) in enumerate(rows):
        raw = (text or "").encode()
        pts.append((i, len(raw) + 1, [coordinate(lang), coordinate(source), len(raw) + 1],
                    (K.LOWEST if doc_id is None else doc_id, zlib.crc32(raw))))
    span = [max(1, max(p[2][d] for p in pts) - min(p[2][d] for p in pts)) for d in range(3)]
    out = {}

    def split(part, first, k):
        if k == 1 or not part:
            out.update({p[0]: first for p in part})
            return
        wide = [(max(p[2][d] for p in part) - min(p[2][d] for p in part)) / span[d] for d in range(3)]
        d = max(range(3), key=lambda d: (wide[d], -d))
        total, before, left, right = sum(p[1] for p in part), 0, [], []
        for p in sorted(part, key=lambda p: (p[2][d], p[3])):
            (left if 2 * (total * (k // 2) - before * k) >= p[1] * k else right).append(p)
            before += p[1]
        split(left, first, k // 2)
        split(right, first + k // 2, k - k // 2)

    split(pts, 0, shards)
    return out


def random_docs(n, seed):
    r = random.Random(seed)
    return [
        (i * r.choice([1, 1, 10**14]) if seed % 2 else i, "é" * r.choice([0, 1, 1, 2, 5, 5, 5, 40, 300]) or None,
         r.choice(["en", "en", "en", "de", None, ""]), f"src{min(r.randrange(9), r.randrange(9))}")
        for i in range(n)
    ]


@pytest.mark.parametrize("shards,seed", [(16, 1), (7, 2)])
def test_kd_tree_matches_sorted_twin(spark, monkeypatch, shards, seed):
    monkeypatch.setattr(K, "HISTOGRAM", 64)  # several passes a cut
    rows = random_docs(400, seed)
    ids = [r[0] for r in rows]
    rows = [r for r in rows if ids.count(r[0]) == 1]
    want = tree_twin(rows, shards)
    got = {r["doc_id"]: r for r in K.shard_rows(documents(spark, rows), shards=shards).collect()}
    assert {rows[i][0]: s for i, s in want.items()} == {d: r["shard"] for d, r in got.items()}
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        assert (got[doc_id]["size"], got[doc_id]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    for s in range(shards):
        own = sorted((r for r in got.values() if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert [r["doc_id"] for r in own] == sorted(r["doc_id"] for r in own)
    # the tree's expression places the rows as the narrow table did, and keeps every column
    docs = documents(spark, rows)
    wide = K.with_shard(docs, shards=shards)
    assert wide.columns == [*docs.columns, "shard_"]
    assert {r["doc_id"]: r["shard_"] for r in wide.collect()} == {d: r["shard"] for d, r in got.items()}
    assert {r["shard"] for r in wide.collect()} == {3}


def test_kd_edges(spark):
    # a third of all rows repeated, a third without id, one very long text, nulls everywhere
    rows = [(7, "same text", "en", "a")] * 60 + [(None, "same text", None, None)] * 60 + [(None, None, "en", "a")] * 5
    rows += [(i, "x" * i, "en", "a") for i in range(100, 150)] + [(1, "y" * 200_000, "de", "b")]
    got = K.shard_rows(documents(spark, rows), shards=4).collect()
    assert len(got) == len(rows)
    want = Counter((d, len((t or "").encode()) + 1) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == want
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    # but for the long text the bytes are even to a document
    small = [r for r in rows if r[0] != 1]
    sums = Counter()
    for r in K.shard_rows(documents(spark, small), shards=4).collect():
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) - min(sums.values()) <= 2 * 151
    few = K.shard_rows(documents(spark, [(1, "a", "en", "s"), (2, None, None, None)])).collect()
    assert sorted(r["doc_id"] for r in few) == [1, 2] and len({r["shard"] for r in few}) == 2
    none = documents(spark, rows).where("1 = 0")
    assert K.shard_rows(none).count() == 0 and K.with_shard(none).count() == 0


def test_kd_target_bytes(spark):
    rows = [(i, "x" * 99, "en", "a") for i in range(100)]
    got = K.shard_rows(documents(spark, rows), target_bytes=2_000).collect()
    assert Counter(r["shard"] for r in got) == {0: 20, 1: 20, 2: 20, 3: 20, 4: 20}


def test_kd_order_of_files_does_not_matter(spark):
    rows = random_docs(120, 4)
    a = K.shard_rows(documents(spark, rows, parts=1)).collect()
    b = K.shard_rows(documents(spark, rows[::-1], parts=6)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


# ---------------------------------------------------------------- periodic runs


def runs_twin(w, min_words=24, min_exponent=3):
    """Every period tried at every place."""
    out = []
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(min_words, min_exponent * q):
                part = w[i : i + n]
                if not any(all(part[x] == part[x + d] for x in range(n - d)) for d in range(1, q)):
                    out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        k = r.choice([1, 2, 2, 3, 5])
        noise = lambda m: [r.randrange(k) for _ in range(r.randrange(m))]
        w = noise(90)
        if r.random() < 0.6:
            base = [r.randrange(k) for _ in range(r.randint(1, 9))]
            w = noise(20) + base * r.randint(2, 8) + base[: r.randint(0, len(base))] + noise(20)
            if r.random() < 0.4:
                w = w * 2 + w[: r.randrange(len(w) + 1)] + w
        yield [b"%d" % x for x in w]


def test_runs_match_brute_force():
    found = 0
    for w in sequences(700, 3):
        for least, exponent in ((24, 3), (4, 2)):
            want = runs_twin(w, least, exponent)
            assert P.runs_of(w, least, exponent) == want
            found += len(want)
    assert found > 2000


def test_extensions_and_ranks_of_the_suffix_tree():
    r = random.Random(8)
    for _ in range(40):
        s = [r.randint(1, 3) for _ in range(r.randint(1, 60))]
        tree = P.SuffixTree(s)
        suffixes = [[*s[i:], 0] for i in range(len(s) + 1)]
        assert [x[0] for x in sorted(enumerate(suffixes), key=lambda x: x[1])] == np.argsort(tree.rank).tolist()
        i, j = np.triu_indices(len(s), 1)
        want = [next(k for k, (x, y) in enumerate(zip(suffixes[a], suffixes[b])) if x != y) for a, b in zip(i, j)]
        assert tree.extension(i, j).tolist() == want


def digest_twin(doc_id, text):
    w = brute.WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_twin(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_run_digests_match_brute_force(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["a", "B", "ß", "c,", "-"]) for _ in range(r.randrange(160)))) for i in range(60)]
    rows += [(i, "\n".join(f"w{x}" for x in range(r.randrange(1, 200)))) for i in range(60, 260)]  # planted periods only
    rows += [(300, None), (301, ""), (302, " \t\n"), (None, "x " * 30), (303, "x " * 30), (303, "x " * 30), (304, "a b\x0bc\x85 " * 9)]
    rows += [(305, ("lorem ipsum dolor " * 400) + "end " * 100), (306, "A a " * 40)]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    got = P.run_digests(P.periodic_runs(P.with_planted_period(docs))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(digest_twin(*r)) for r in rows)
    assert sum(r["n_runs"] for r in got if r["doc_id"] in range(60, 260)) > 10
    assert P.periodic_runs(docs.where("1 = 0")).count() == 0


def test_very_long_texts():
    base = [b"%d" % i for i in range(9_000)]
    w = [*base, *(base[:5_000] * 5), *base]
    assert P.runs_of(w) == [(4_000 + 5_000, 25_000 + 5_000, 5_000)] or P.runs_of(w) == [(9_000, 30_000, 5_000)]
    assert P.runs_of([b"a"] * 60_000) == [(0, 60_000, 1)]
    assert P.runs_of([b"%d" % i for i in range(300_000)]) == []


# ---------------------------------------------------------------- best position search


def search_twin(items, docs, k=20):
    """Every document scored for every item."""
    terms = [B.terms_of(t or "") for _, t in docs]
    n_docs, n_terms = sum(bool(t) for t in terms), sum(map(len, terms))
    df = Counter(x for t in terms for x in set(t))
    out = []
    wanted: dict = {}
    for item, text in dict.fromkeys(items):
        wanted.setdefault(item, Counter()).update(B.terms_of(text or ""))
    for item, query in wanted.items():
        scored = []
        for (doc_id, _), t in zip(docs, terms):
            tf = Counter(t)
            m = t and 75 + 25 * len(t) * n_docs // n_terms
            score = sum(
                c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m))
                for x, c in query.items() if tf[x]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


WORDS = ["the", "The", "of", "to", "and", "ñu", "Ñu", "x1", "a'b", "rare", "q", "z-z"]


def corpus(n, seed):
    r = random.Random(seed)
    pick = lambda: WORDS[min(r.randrange(len(WORDS)), r.randrange(len(WORDS)))]
    return [(i, " ".join(pick() for _ in range(r.choice([0, 1, 3, 9, 30])))) for i in range(n)]


def test_search_matches_brute_force(spark):
    docs = corpus(300, 1)
    docs += [(300, None), (301, "--"), (None, "rare rare"), (None, "the x1"), (302, "ñu " * 4000), (302, "ñu " * 4000)]
    docs += [(i, "rare x1") for i in range(400, 430)]  # ties beyond k
    items = [(1, "The rare"), (2, "ñu"), (2, "ñu"), (2, "q"), (None, "of of of z"), (3, None), (4, "unheard"), (5, " ".join(WORDS))]
    item_rows = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, id int")
    got = B.best_documents(item_rows, documents(spark, [(i, t, "en", "s") for i, t in docs]))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, search_twin(items, docs)))


def test_search_of_empty_tables(spark):
    docs = documents(spark, [(1, "the", "en", "s")])
    items = spark.createDataFrame([("a", "the")], "item_id string, text string")
    assert B.best_documents(items.where("1 = 0"), docs).count() == 0
    assert B.best_documents(items, docs.where("1 = 0")).count() == 0
    assert [tuple(r) for r in B.best_documents(items, documents(spark, [(1, "the", "e", "s"), (2, "of", "e", "s")])).collect()] == [
        r for r in search_twin([("a", "the")], [(1, "the"), (2, "of")])
    ]


def test_slices_of_queries(spark, monkeypatch):
    monkeypatch.setattr(B, "SLICE_CHARS", 8)
    docs = corpus(80, 2)
    items = [(i, " ".join(WORDS[i : i + 3])) for i in range(6)] + [(0, "q")]
    got = B.best_documents(
        spark.createDataFrame(items, "item_id long, text string"), documents(spark, [(i, t, "en", "s") for i, t in docs])
    )
    assert sorted(map(tuple, got.collect())) == sorted(search_twin(items, docs))
    assert len(list(B.query_slices(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text"))) > 2


def block_of(docs):
    terms = [B.terms_of(t) for _, t in docs]
    names = sorted({x for t in terms for x in t})
    n = np.array([len(t) for t in terms])
    post = [(d, names.index(x), c) for d, t in enumerate(terms) for x, c in Counter(t).items()]
    doc, term, tf = (np.array(c) for c in zip(*post))
    return names, B.Block(n, doc, term, tf, int((n > 0).sum()), int(n.sum()))


@pytest.mark.parametrize("room", [B.PLACES, 0])
def test_blocks_stop_early_and_exactly(monkeypatch, room):
    """Chunks of one place, with and without dense place tables: right results from a part of the lists."""
    monkeypatch.setattr(B, "CHUNK", 1)
    monkeypatch.setattr(B, "PLACES", room)
    r = random.Random(4)
    docs = [(i, " ".join(["the"] * r.randint(1, 30) + ["of"] * r.randint(0, 30) + ["pad"] * r.randint(1, 60))) for i in range(4000)]
    names, block = block_of(docs)
    query = [(names.index("the"), 3), (names.index("of"), 2)]
    best = B.Best(5)
    read = B.search_block(block, query, np.arange(4000), np.zeros(4000, bool), best)
    score = np.zeros(4000, np.int64)
    for t, w in query:
        a, b = block.span[t]
        score[block.doc[a:b]] += w * block.impact[a:b]
    order = np.lexsort((np.arange(4000), -score))[:5]
    assert best.id.tolist() == order.tolist() and best.score.tolist() == score[order].tolist()
    assert read < 4000
    # a later block of the same documents under greater ids: equal scores enter behind the smaller id
    assert B.search_block(block, query, np.arange(4000) + 4000, np.zeros(4000, bool), best) <= read
    twice = np.lexsort((np.arange(8000), -np.r_[score, score]))[:5]
    assert best.id.tolist() == twice.tolist()
    # and one that cannot beat the kth score is left after its first places
    _, poor = block_of([(i, "the of" + " pad" * 400) for i in range(500)])
    assert B.search_block(poor, [(2, 3), (0, 2)], np.arange(500) + 9000, np.zeros(500, bool), best) == 2
    assert best.id.tolist() == twice.tolist()


def test_a_threshold_equal_to_the_kth_score_goes_on(monkeypatch):
    """Equal scores: the smallest ids win even where they are last in the lists."""
    monkeypatch.setattr(B, "CHUNK", 1)
    _, block = block_of([(i, "the") for i in range(50)])
    best = B.Best(3)
    B.search_block(block, [(0, 1)], np.arange(50)[::-1].copy(), np.zeros(50, bool), best)
    assert best.id.tolist() == [0, 1, 2]
