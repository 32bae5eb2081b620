"""Exact and near dedup, quality rules: brute force, ties, nulls, repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from finelens.llm import exact_dedup, hyperminhash, pii_surrogates, quality_rules

from . import brute

#: Extra columns named like columns that the operators use inside.
CLASH = "id long, node string, key int, n int, run string, type string, first int"


def table(spark, rows):
    data = [(i, t, 1, "x", 2, 3, "r", "t", 4) for i, t in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, {CLASH}").repartition(3)


EDGE = [
    (5, "a  b\tc"), (3, "a b c"), (9, "a b c "), (7, None), (8, ""), (8, ""), (None, "lone"), (None, "a b c"),
    (12, " \n\t "), (13, " "), (20, "x" * 300_000), (21, "x" * 300_000), (3, "a b c"),
]


def test_exact_groups_edges(spark):
    got = exact_dedup.exact_groups(table(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    groups: dict = {}
    for i, t in EDGE:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept: dict = {}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        named = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == (min(named) if named else None)
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}  # one row of each group, repeated rows too


def test_runs_merge_in_binomial_rounds_without_a_new_sort(spark, monkeypatch):
    made = []
    write = exact_dedup.run_table

    def seen(entries, buckets, k):
        name = write(entries, buckets, k)
        plan = exact_dedup.merged(spark.table(name))._jdf.queryExecution().executedPlan().toString()
        made.append((k, spark.table(name).select("run").distinct().count(), plan))
        return name

    monkeypatch.setattr(exact_dedup, "run_table", seen)
    rows = [(i, f"text {i % 37}", 1, "x", 2, 3, "r", "t", 4) for i in range(400)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}").repartition(11)
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(i, i % 37, 11 if i % 37 < 30 else 10) for i in range(400)]
    assert [k for k, _, _ in made] == [0, 1, 2, 3]  # ceil(log2(11)) rounds
    for _, _, plan in made:
        assert "SortMergeJoin" in plan and "FullOuter" in plan
        assert "Exchange" not in plan and "Sort [" not in plan, plan
    made.clear()
    assert exact_dedup.exact_groups(docs.coalesce(1)).count() == 400 and not made  # one run: nothing to merge


def test_drop_copies_keeps_one_row_of_each_text(spark):
    docs = table(spark, EDGE)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, re.sub(r"\s+", " ", r["text"] or "")) for r in out.collect())
    assert got == sorted([(False, 3, "a b c"), (False, 9, "a b c "), (False, 7, ""), (True, 0, "lone"), (False, 12, " "), (False, 20, "x" * 300_000)])


def test_empty_tables(spark):
    none = table(spark, EDGE).where("1 = 0")
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == 0
    assert quality_rules.judge_documents(none).count() == 0
    assert hyperminhash.near_groups(none).count() == 0


def random_text(rng: random.Random, words: int) -> list[str]:
    return ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(words)]


@pytest.fixture(scope="module")
def near_texts():
    """Clusters around the threshold, chains, tiny sets, one large group of near copies."""
    rng, out = random.Random(11), {}
    for c in range(25):
        base = random_text(rng, rng.choice([3, 5, 8, 20, 60, 150, 700]))
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = "zz" + str(rng.randint(0, 99))
            out[len(out) * 3 + 1] = (" " if rng.random() < 0.7 else "\n ").join(w).upper() if rng.random() < 0.2 else " ".join(w)
    base = random_text(rng, 120)
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = "q" + str(rng.randint(0, 9999))
        out[len(out) * 3 + 1] = " ".join(w)
    return out | {2: None, 3: "", 5: " \n", 6: "word", 8: "WORD", 9: "éa Éa", 11: "éa Éa"}


def test_near_groups_match_all_pairs(spark, near_texts):
    want = brute.near_components(near_texts)
    got = {r["doc_id"]: r for r in hyperminhash.near_groups(table(spark, list(near_texts.items()))).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(got[d]["n_shingles"] == len(brute.shingles(t)) for d, t in near_texts.items())
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


@pytest.mark.parametrize("width", [1, 5])
def test_near_groups_of_other_widths_match_all_pairs(spark, near_texts, width):
    texts = near_texts | {14: "four words stand here", 15: "FOUR words stand  here", 17: "four words stand", 18: "words four stand here"}
    want = brute.near_components(texts, width)
    assert want != brute.near_components(texts)
    got = {r["doc_id"]: r for r in hyperminhash.near_groups(table(spark, list(texts.items())), width=width).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(got[d]["n_shingles"] == len(brute.shingles(t, width)) for d, t in texts.items())


def test_near_groups_nulls_and_repeated_rows(spark):
    t = "one two three four five six"
    rows = [(4, t), (4, t), (None, t), (2, None), (2, None), (None, "nobody else"), (7, t + " seven")]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in hyperminhash.near_groups(table(spark, rows)).collect()]
    want = [(4, 4, True), (4, 4, True), (None, 4, False), (2, 2, True), (2, 2, True), (None, None, False), (7, 4, False)]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_keep_one_of_each_judges_rows_not_ids(spark):
    base = " ".join(f"w{i}" for i in range(40))
    near = [base + f" {x}" for x in ("alpha", "beta", "gamma", "delta", "epsilon")]
    alone = " ".join(f"u{i}" for i in range(30))
    nobody = " ".join(f"v{i}" for i in range(30))
    rows = [
        (1, near[0]), (1, near[1]),  # the kept id has two near-equal texts: one stays
        (4, near[2]), (4, alone),  # a copy, and a text of its own under the same id
        (None, near[3]), (None, near[4]),  # copies without an id
        (None, nobody), (None, nobody + " end"), (None, nobody),  # near copies on rows without an id only
        (6, "lone text of six words here"), (6, "lone text of six words here"), (7, None), (None, " "),
    ]
    docs = table(spark, rows)
    out = hyperminhash.keep_one_of_each(docs)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len([r for r in got if r[0] == 1]) == 1 and not any(t in near for d, t in got if d != 1)
    assert [t for d, t in got if d == 4] == [alone]
    assert len([t for d, t in got if t and t.startswith(nobody)]) == 1
    assert got.count((6, rows[-3][1])) == 1 and (7, None) in got and (None, " ") in got
    assert len(got) == 6
    again = hyperminhash.keep_one_of_each(docs.where("doc_id = 9"))
    assert again.count() == 0


def test_registers_estimate_and_bound():
    rng = np.random.default_rng(3)
    for n in (40, 600, 5000):
        for j in (0.5, 0.8, 0.95):
            both = int(2 * n * j / (1 + j))
            x = np.unique(rng.integers(0, 2**64, both, np.uint64))
            a, b = (np.unique(np.r_[x, rng.integers(0, 2**64, n - both, np.uint64)]) for _ in range(2))
            est = hyperminhash.estimate(*(hyperminhash.registers(s)[None] for s in (a, b)), np.array([n]), np.array([n]))[0]
            assert abs(est - j) < 0.35 if n == 40 else abs(est - j) < 0.13
    unrelated = [np.unique(rng.integers(0, 2**64, 3000, np.uint64)) for _ in range(40)]
    regs = np.stack([hyperminhash.registers(u) for u in unrelated])
    agree = np.mean([(regs[i] == regs[k]).mean() for i in range(40) for k in range(i)])
    assert abs(agree - hyperminhash.expected_collision([3000], [3000])[0]) < 2e-4


QUALITY = [
    None, "", " \n ", "Short.", "Home | About | Contact | Help\n" * 4 + "This is a line of plain text that ends well and says more.",
    "The quick brown fox jumps over the lazy dog. It does so again and again, every day.",
    "one two three four five six seven eight nine ten " * 3, "a b c d e a b c d e f g h i j k l m n o p q r s t u v w x y z.",
    "All rights reserved.\nA real sentence stands here with enough words to stay in.\nA real sentence stands here with enough words to stay in.",
    "### *** &&& word " * 20, "menu\nlogin\n" + "Some proper text goes on for quite a while and then it stops.", "x" * 200_000 + " and more words here to reach ten of them all.",
    "Next we turn to a paragraph that names the privacy policy of a house, and it goes on for more than twenty words in all, as prose does.",
    "Alle Rechte vorbehalten.\nPolítica de privacidad.\nInicio\nEin Satz mit genügend Wörtern steht hier und bleibt im Text stehen.",
    "Next page\nNext we shall see how the matter stands today.\nThen a line of plain text follows it and ends well.",
    "é ü ñ words with accents are words too, and this line has many.\x0b\x0cEnd.",
]


def test_phrases_fail_short_lines_only():
    kept = [brute.quality(t)["kept"] for t in QUALITY if t and t.startswith(("Next we turn", "Alle Rechte", "Next page"))]
    assert kept == [True, True, True]


def test_quality_matches_brute_force(spark):
    docs = table(spark, list(enumerate(QUALITY)) + [(1, QUALITY[1]), (None, QUALITY[5])])
    got = quality_rules.judge_documents(docs).collect()
    assert len(got) == len(QUALITY) + 2
    for r in got:
        want = brute.quality(QUALITY[5 if r["doc_id"] is None else r["doc_id"]])
        for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"):
            assert r[c] == want[c], (r["doc_id"], c)
    clean = quality_rules.clean_documents(docs)
    assert clean.columns == docs.columns
    for r in clean.collect():
        want = brute.quality(QUALITY[5 if r["doc_id"] is None else r["doc_id"]])
        assert want["kept"] and r["text"] == want["clean_text"]


def near_copies(n, words=120, seed=5):
    """One group: n copies of a text with 0 to 9 of its words changed."""
    rng = random.Random(seed)
    base, out = random_text(rng, words), []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = "q" + str(rng.randint(0, 99_999))
        out.append((i, " ".join(w)))
    return out


def test_links_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    made: dict = {}
    keep = hyperminhash.stored

    def counted(df, label):
        out = keep(df, label)
        made[label] = made.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(hyperminhash, "stored", counted)
    seen = []
    for n in (200, 400, 800):
        made.clear()
        rows = near_copies(n)
        got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_groups(table(spark, rows)).collect()}
        if n == 200:
            assert got == brute.near_components(dict(rows))
        seen.append((made["star-pairs"], made.get("residual-pairs", 0), made.get("links", 0)))
    for few, many in zip(seen, seen[1:]):
        assert all(b <= 2.5 * a + 20 for a, b in zip(few, many)), seen


@pytest.mark.parametrize("size", [511, 512, 513])
def test_sets_about_the_bound_of_small_ones(spark, size):
    """Pairs at the threshold and one below it, in a group whose hub links with neither."""
    words = [f"w{i}" for i in range(size + 1)]  # size shingles of two words
    most = max(k for k in range(size) if 100 * (size - k) >= 80 * (size + k))
    rows = [(1, " ".join(words))]
    for doc, changed in ((2, most), (3, most + 1)):
        rows.append((doc, " ".join(words[: size + 1 - changed] + [f"x{doc}_{i}" for i in range(changed)])))
    rows += [(10 + i, t) for i, t in enumerate(t for _, t in rows)]
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_groups(table(spark, rows)).collect()}
    assert got == brute.near_components(dict(rows))


def test_quotas_lose_no_link_of_large_sets(spark, monkeypatch):
    """Every set counts as large, one candidate a round: still all links."""
    monkeypatch.setattr(hyperminhash, "SMALL", 0)
    rows = near_copies(60, words=90, seed=9) + [(100 + i, t) for i, t in near_copies(30, words=70, seed=3)]
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_groups(table(spark, rows)).collect()}
    assert got == brute.near_components(dict(rows))


def test_texts_that_share_a_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "NODE_BITS", 3)
    texts = [" ".join(f"t{i}_{k}" for k in range(12)) for i in range(40)]
    rows = list(enumerate(texts)) + [(100 + i, t + " more") for i, t in enumerate(texts)]
    rows = [(i, t + " " + " ".join(f"same{k}" for k in range(2))) for i, t in rows]
    out = hyperminhash.keep_one_of_each(table(spark, rows))
    want = {min(ids) for ids in brute_groups(rows).values()}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(want)


def brute_groups(rows):
    groups: dict = {}
    for d, c in brute.near_components(dict(rows)).items():
        groups.setdefault(c, []).append(d)
    return groups


def test_columns_of_any_name_are_kept(spark):
    odd = "__m string, __pii int, __p int, __r int, __uid int, __key string, __w int, __node long, __j string, __q int, __t string, __lines int, __good int, __kept string, c0 int, c1 string, `a.b` int"
    base = "This is a line of plain text that ends well and says a good deal more than it must."
    rows = [(i, base + f" Number {i}, see a{i}@b.com.", "m", 8, 9, 10, 11, "k", 1, 2, "j", 3, "t", 4, 5, "y", 6, "z", 7) for i in (1, 2)]
    docs = spark.createDataFrame(rows + [rows[0]], f"doc_id long, text string, {odd}")
    for op in (exact_dedup.drop_copies, hyperminhash.keep_one_of_each, quality_rules.clean_documents, pii_surrogates.anonymised):
        out = op(docs)
        assert out.columns == docs.columns
        for r in out.collect():
            assert tuple(r)[2:] == rows[0][2:], op
