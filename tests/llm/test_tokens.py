"""Token operators: the libraries' own ids, exact round trips, packing bounds."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from finelens.llm import merge_replay, packing, repair, tokens

CLASH = "id long, part int, shard int, bin int, piece string, length string, pid int"


def odd_texts(n: int = 400) -> list[str | None]:
    rng = random.Random(5)
    alphabet = list("ab Z1'.,\n\t é 日🙂́İ\x1c")
    fixed = [
        None, "", " ", "\n", "a", " a", "a ", "a  b", "a \n b\n\nc", "don't I'll we're 'S", "　日本 語 1234 ½ ٣٤", "İstanbul ΑΣ ǅ ß ẞ",
        "<|endoftext|> a<|startoftext|>", "\x1ca \x1f b", "🙂 👍🏽 ok", "a\r\nb", "\x85 z", "foo,bar. Baz!\nQux's\n\n  y", "a" * 3000, "ab" * 700,
    ]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def table(spark, rows):
    data = [(i, t, 1, 2, 3, 4, "p", "q", 5) for i, t in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, {CLASH}").repartition(3)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    texts = odd_texts(1500)
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    coder = tokens.Encoder(public_tokenizers.path(name))
    for part in (texts[:700], texts[700:], texts[:50]):  # the second call meets a filled cache
        want = [e.ids for e in library.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert [x.tolist() for x in coder.encode(pa.array(part, pa.string()))] == want


def test_merge_replay_equals_tiktoken(spark):
    path = public_tokenizers.path(merge_replay.VOCABULARY)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge_replay.load_ranks(path), special_tokens={}
    )
    rows = list(enumerate(odd_texts())) + [(3, "\n"), (None, "no id")]
    out = merge_replay.encoded(table(spark, rows), with_ids=True)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in out.collect())
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append(
            (str(i), len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest(), ids)
        )
    assert got == sorted(want)
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in merge_replay.decoded(out.where("doc_id > 4")).collect()}
    assert all(back[i] == t for i, t in rows if i is not None and i > 4)


def test_merge_order_is_rank_order_even_where_ranks_go_back():
    # "abc" (rank 300) is lower than "ab" (400): a merge makes a pair of a past rank
    ranks = {bytes([b]): b for b in range(256)} | {b"cd": 260, b"abc": 300, b"ab": 400, b"abcd": 500, b"bc": 450}
    replay = merge_replay.MergeReplay(ranks)
    words = [b"abc", b"abcd", b"aabbcc", b"ababab", b"aaaa", b"cdcdab", b"abcabcd"]
    assert replay.encode(words) == [replay.alone(w) for w in words]


def test_shards_round_trip(spark, monkeypatch):
    monkeypatch.setattr(repair, "SHARD_IDS", 200)
    rows = list(enumerate(odd_texts(200))) + [(3, "\n"), (None, "null ids come last")]
    got = repair.round_trip(table(spark, rows)).collect()
    library = Tokenizer.from_file(public_tokenizers.path(repair.VOCABULARY))
    library.encode_special_tokens = True
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, repair.END_ID], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want
    assert repair.round_trip(table(spark, rows[:1]).where("1 = 0")).count() == 0


def test_grammar_random_access():
    rng = random.Random(2)
    phrase = [rng.randrange(50_000) for _ in range(40)]
    docs = [np.array(phrase[rng.randrange(30) :] * rng.randint(1, 9) + [2], np.uint32) for _ in range(60)]
    docs += [np.array([7] * 101, np.uint32), np.array([2], np.uint32), np.array([5, 5, 5], np.uint32)]
    payload = repair.pack_shard([None, *range(1, len(docs))], docs)
    shard = repair.Shard(payload)
    assert len(shard.rules) and len(shard.sequence) < sum(map(len, docs)) // 4
    ids, at = shard.all_ids()
    assert (ids == np.concatenate(docs)).all() and at[-1] == len(ids)
    assert shard.doc_ids == [None, *range(1, len(docs))]
    for k, d in enumerate(docs):
        assert (shard.document(k) == d).all()
        a = rng.randint(0, len(d))
        b = rng.randint(a, len(d))
        assert (shard.decode_range(k, a, b) == d[a:b]).all()
    # rules expand to as many ids as they say
    for r, n in enumerate(shard.lengths.tolist()):
        assert len(shard.expand(np.array([repair.FIRST_RULE + r]))) == n


def check_packed(rows):
    at: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(v <= packing.CAPACITY for v in at.values())
    return at


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 60)  # several partitions and rounds
    monkeypatch.setattr(packing, "FAN_IN", 3)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["word", "a", "42", "x.y"]) for _ in range(rng.randint(0, 1500)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "é " * 9000), (1002, "é " * 9000), (None, "no id")]
    out = packing.packed_documents(table(spark, rows), with_ids=True)
    got = out.collect()
    at = check_packed(got)
    cert = packing.certificate(out)
    assert cert["sequences"] == len(at) and cert["bound"] <= len(at) <= cert["bound"] + 1
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        for k in range(0, len(ids), packing.CAPACITY):
            part = ids[k : k + packing.CAPACITY]
            want.append((str(i), k // packing.CAPACITY, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert packing.packed_documents(table(spark, rows[:1]).where("1 = 0")).count() == 0


def test_bounds_are_below_the_best_packing():
    rng = random.Random(4)
    for _ in range(60):
        lengths = np.array([rng.randint(1, packing.CAPACITY) for _ in range(rng.randint(1, 40))])
        bound = packing.lower_bound(np.bincount(lengths, minlength=packing.CAPACITY + 1))
        _, _, free = packing.best_fit_decreasing(lengths)
        assert np.ceil(bound - 1e-9) <= len(free)
        assert bound >= lengths.sum() / packing.CAPACITY - 1e-9
    third = np.full(9, packing.CAPACITY // 3 + 1)
    assert packing.lower_bound(np.bincount(third, minlength=packing.CAPACITY + 1)) >= 4.5 - 1e-9


def test_encoder_remembers_up_to_its_cache(monkeypatch):
    texts = pa.array([f"word{i} alpha beta" for i in range(500)])
    learned = {}
    ids = {}
    for cache in (1, 100_000):
        coder = tokens.Encoder(tokens.vocabulary(repair.VOCABULARY), cache)
        sizes = []
        learn = coder.learn
        monkeypatch.setattr(coder, "learn", lambda h, raws, f=learn, n=sizes: (n.append(len(raws)), f(h, raws)))
        ids[cache] = [x.tolist() for _ in range(2) for x in coder.encode(texts)]
        learned[cache] = len(sizes)
    assert learned == {1: 2, 100_000: 1} and ids[1] == ids[100_000]
    # shards remember more than others, whose encoders keep their own bound
    assert repair.SEGMENTS > tokens.CACHE == tokens.encoder(tokens.vocabulary(repair.VOCABULARY)).cache


def test_encoder_searches_no_more_than_it_must(monkeypatch):
    coder = tokens.Encoder(tokens.vocabulary(repair.VOCABULARY))
    learned = []
    learn = coder.learn
    monkeypatch.setattr(coder, "learn", lambda h, raws: (learned.extend(raws), learn(h, raws)))
    splits = []
    monkeypatch.setattr(coder, "split", lambda text, f=coder.split: (splits.append(text), f(text))[1])

    class Never:
        def search(self, text):
            raise AssertionError("plain text holds no wide blank")

    texts = ["Été Ôter thé", "mot\nÉté\nÔter", None, "x\nÉté", "\nÉté", "fin\n"]
    want = [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    with monkeypatch.context() as m:
        m.setattr(tokens, "_WIDE_BLANKS", Never())
        assert [x.tolist() for x in coder.encode(pa.array(texts))] == want
    # the first word of a line is a segment without its line break; words of Latin letters are not split by the pattern
    assert not [raw for raw in learned if raw[:1] == b"\n" and len(raw) > 1 and raw != b"\n" + "Été".encode()]
    assert all("\n" in text for text in splits)
    wide = ["a b  c", "don’t  x", "　 y"]
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in wide]
    assert [x.tolist() for x in coder.encode(pa.array(wide))] == want


def test_places_of_hashes_with_equal_leading_bits():
    rng = np.random.default_rng(4)
    near = np.uint64(5 << 60) + rng.integers(0, 50, 400).astype(np.uint64)
    for hashes in (near, rng.integers(0, 1 << 64, 300, np.uint64), near[:1], near[:0], np.array([2**64 - 1, 0, 2**64 - 1], np.uint64)):
        distinct, place = tokens.places(hashes)
        assert distinct.tolist() == sorted(set(hashes.tolist()))
        assert (distinct[place] == hashes).all()


def test_rounds_whatever_shares_a_slot(monkeypatch):
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 6, rng.integers(0, 90)).astype(np.uint32) for _ in range(40)] + [np.full(31, 3, np.uint32)]
    made = set()
    for bits in (1, 4, 22):  # with 2 slots, most of the chosen pairs are hidden by others
        monkeypatch.setattr(repair, "PAIR_BITS", bits)
        table = repair.PairTable(np.arange(100, 140, dtype=np.uint32))
        keys, chosen = np.arange(90, 150, dtype=np.uint32), np.array([130, 101, 117, 139], np.uint32)
        code = table.codes(table.slots(keys), chosen)
        spot, pair = table.found(keys, code)
        assert keys[spot].tolist() == [101, 117, 130, 139] and chosen[pair].tolist() == [101, 117, 130, 139]
        assert (code[10:50] > 0).all()
        made.add(repair.pack_shard(list(range(len(docs))), docs))
    assert len(made) == 1
    shard = repair.Shard(made.pop())
    assert len(shard.rules) and all((shard.document(k) == d).all() for k, d in enumerate(docs))


def test_overlapping_pairs():
    # the pairs of a a a a b c: (a, a) at 0, 1, 2, (a, b) at 3, (b, c) at 4; what loses to a loser loses, too
    at = np.arange(5)
    for rule, where in (([0, 0, 0, 1, 2], [0, 2]), ([1, 1, 1, 0, 2], [0, 3]), ([0, 0, 0, 0, 0], [0, 2, 4])):
        got, own = repair.occurrences(at, at, np.array(rule))
        assert got.tolist() == where and own.tolist() == [rule[k] for k in where]
