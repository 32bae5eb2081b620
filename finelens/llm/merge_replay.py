"""Byte-level BPE by replaying merges over all distinct words at once.

The distinct words (matches of the split pattern) of a batch form the corpus
of a replay.  Their bytes lie in one array with links to the left and right
neighbour; an inverted index holds, for every merge rank, the positions of the
token pairs that this merge joins.  Ranks are taken in ascending order; a
merge visits its positions only, and only the pairs to the left and right of
a merged one are looked up again and filed under their rank.  Words do not
act on each other, so replaying the words of one batch gives what a replay
over the whole corpus gives; a worker keeps the words it has replayed for its
next batches, and no word table travels.

Where a merge creates a pair of a rank that is already past (a vocabulary may
allow it), the word is encoded alone, lowest rank first, leftmost on ties.

Defined results
---------------
* null text is the empty text: no ids, the digests of the empty string;
* repeated rows and null ids are encoded row by row; an empty table gives an
  empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finelens.llm import tokens

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: No merge joins the pair.
NEVER = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Replays the merges of a rank file over lists of distinct words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.shown = {r: t for t, r in ranks.items()}
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pair_keys = np.zeros(0, np.int64)  # sorted pairs seen so far
        self.pair_ranks = np.zeros(0, np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of token pairs, NEVER where there is none."""
        keys = left.astype(np.int64) << 32 | right
        pos = np.searchsorted(self.pair_keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.pair_keys):
            pos = np.minimum(pos, len(self.pair_keys) - 1)
            known = self.pair_keys[pos] == keys
        if not known.all():
            fresh = np.unique(keys[~known])
            found = [
                self.ranks.get(self.shown[k >> 32] + self.shown[k & 0xFFFFFFFF], int(NEVER)) for k in fresh.tolist()
            ]
            at = np.searchsorted(self.pair_keys, fresh)
            self.pair_keys = np.insert(self.pair_keys, at, fresh)
            self.pair_ranks = np.insert(self.pair_ranks, at, np.array(found, np.int32))
            pos = np.searchsorted(self.pair_keys, keys)
        return self.pair_ranks[pos]

    def alone(self, word: bytes) -> list[int]:
        """One word, lowest rank first, leftmost on ties."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, int(NEVER)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == NEVER:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of the distinct non-empty ``words``."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        token = self.byte_rank[np.frombuffer(b"".join(words), np.uint8)]
        right = np.arange(1, n + 1, dtype=np.int64)
        right[ends - 1] = -1
        left = np.arange(-1, n - 1, dtype=np.int64)
        left[ends - sizes] = -1
        rank = np.full(n, NEVER, np.int32)  # of the pair that starts at a position
        paired = np.flatnonzero(right >= 0)
        rank[paired] = self.rank_of(token[paired], token[paired + 1])
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        odd: list[np.ndarray] = []

        def file(positions: np.ndarray) -> None:
            """Enters positions in the inverted index under their pair's rank."""
            r = rank[positions]
            order = np.argsort(r, kind="stable")
            positions, r = positions[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(r)]):
                index.setdefault(int(r[a]), []).append(positions[a:b])

        live = paired[rank[paired] != NEVER]
        if len(live):
            file(live)
        top = max(self.shown) + 1
        for r in range(top):
            lists = index.pop(r, None)
            if lists is None:
                continue
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[rank[at] == r]  # the others were touched by an earlier merge
            if len(at) > 1:
                at = np.unique(at)
                # a pair that overlaps the one to its left waits; runs join from their start
                chained = np.r_[False, right[at[:-1]] == at[1:]]
                if chained.any():
                    start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            gone = right[at]
            after = right[gone]
            token[at] = r
            alive[gone] = False
            rank[gone] = NEVER
            right[at] = after
            inner = after >= 0
            left[after[inner]] = at[inner]
            rank[at] = NEVER
            before = left[at]
            touched = np.concatenate([at[inner], before[before >= 0]])
            if len(touched):
                now = self.rank_of(token[touched], token[right[touched]])
                rank[touched] = now
                past = now <= r
                if past.any():
                    odd.append(touched[past])
                    now = np.where(past, NEVER, now)
                ahead = touched[now != NEVER]
                if len(ahead):
                    file(ahead)
        ids = token[alive].tolist()
        upto = np.r_[0, np.cumsum(alive)][np.r_[0, ends]].tolist()
        out = [ids[a:b] for a, b in zip(upto[:-1], upto[1:])]
        if odd:
            for w in np.unique(np.searchsorted(ends, np.concatenate(odd), "right")).tolist():
                out[w] = self.alone(words[w])
        return out


class ReplayEncoder(tokens.Encoder):
    """Encoder of text columns whose words are encoded by merge replay."""

    def __init__(self, path: str):
        import public_tokenizers

        self.replay = MergeReplay(load_ranks(path))
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.by_word = False
        self.shown = self.replay.shown
        self.decimal = {r: str(r).encode() for r in self.shown}
        self.reset()

    def ids_of_all(self, raws: list[bytes]) -> list[Sequence[int]]:
        parts = []
        for raw in raws:
            text = raw.decode("utf-8")
            parts.append([text] if tokens.simple(text) else self.split(text))
        words = list({w for part in parts for w in part})
        known = dict(zip(words, self.replay.encode([w.encode("utf-8") for w in words])))
        return [known[part[0]] if len(part) == 1 else [i for w in part for i in known[w]] for part in parts]


@lru_cache(maxsize=2)
def replay_encoder(path: str) -> ReplayEncoder:
    return ReplayEncoder(path)


def _digester(path: str, with_ids: bool):
    def run(batches):
        coder = replay_encoder(path)
        decimal, shown = coder.decimal.__getitem__, coder.shown.__getitem__
        for b in batches:
            n, ids_sha, text_sha, kept = [], [], [], []
            for row in coder.encode(b.column(1)):
                ids = row.tolist()
                n.append(len(ids))
                ids_sha.append(sha256(b",".join(map(decimal, ids))).hexdigest())
                text_sha.append(sha256(b"".join(map(shown, ids))).hexdigest())
                if with_ids:
                    kept.append(row)
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def encoded(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_tokens, digests of the ids and of the decoded bytes (and the ids)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(_digester(path or tokens.vocabulary(VOCABULARY), with_ids), schema)


def decoder(path: str):
    def run(batches):
        shown = replay_encoder(path).shown
        for b in batches:
            out = [b"".join(shown[i] for i in ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return run


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids); null ids give no bytes."""
    return rows.select("doc_id", "ids").mapInArrow(decoder(path or tokens.vocabulary(VOCABULARY)), "doc_id long, bytes binary")
