"""Token shards compressed by Re-Pair grammars, with random access.

Documents are range-partitioned and sorted by id; every task encodes its texts
and cuts them into shards of whole documents.  Within a shard, frequent
adjacent id pairs are replaced by nonterminals again and again, most frequent
first, never across a document's end.  A shard's payload is one binary value:

    magic, counts            6 little-endian uint32
    doc ids                  int64 each, and a null mask (1 byte each)
    symbol offsets, tokens   uint32 each: where a document starts in the
                             sequence, how many ids it expands to
    rules                    left and right symbol (uint32 each) and expansion
                             length (uint32) of every nonterminal
    sequence                 uint16 symbols

Shards are Parquet rows in the shared folder, numbered in ascending id order.
Expansion lengths let ``decode_range`` skip to any id of a document without
expanding what precedes it.

Defined results
---------------
* null text is the empty text: its document holds the end id alone;
* null ids come last; repeated rows stay rows of their own, side by side;
* an empty table writes no shard and reads back as no row;
* a longer text than a shard makes a shard of its own; further columns are
  ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finelens.llm import tokens
from finelens.llm.common import new_path, stored

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: First nonterminal; symbols stay below 2**16, which bounds the rules of a shard.
FIRST_RULE = 50_257
SYMBOLS = 1 << 16
#: Ids that close a shard.
SHARD_IDS = 1 << 20
#: Distinct segments a worker remembers, some 60 bytes each: rare ones come back after many documents.
SEGMENTS = 1_600_000
#: A rule costs 12 bytes and saves 2 a use: rarer pairs are left alone.
MIN_USES = 8
#: A round replaces the pairs with at least this share of the highest count.
ROUND_SHARE = 0.05
#: The round that shortens the sequence by less than this share is the last: the long tail of rounds saves under 1 %.
LAST_SHARE = 1 / 128

MAGIC = 0x52504731
HEAD = struct.Struct("<6I")


#: Bits at most of the tables of pair hashes, which have SLOTS slots a frequent pair.
PAIR_BITS = 22
SLOTS = 16
#: Least share of the sequence from which all its pairs are made at once.
DENSE_SHARE = 1 / 4


class Rounds:
    """Re-Pair over one sequence of documents: each round replaces the most frequent pairs at once.

    All pairs are counted in the first round.  From then on a pair of old symbols can only become
    rarer, so what is counted again are the places of the pairs that were frequent and the
    neighbours of what was replaced; the rest of the sequence is not looked at.
    """

    def __init__(self, seq: np.ndarray, offs: np.ndarray):
        self.seq, self.offs = seq.astype(np.uint16), offs  # ``offs``: the documents' n + 1 offsets
        self.next_rule = FIRST_RULE
        self.look = np.ones(len(seq), bool)  # mask of the places of the pairs to count

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places to count whose symbol and the next belong to one document, and their pairs."""
        seq = self.seq
        if len(seq):
            self.look[self.offs[1:] - 1] = False
        at = np.flatnonzero(self.look)
        if len(at) < DENSE_SHARE * len(seq):
            return at, seq[at].astype(np.uint32) << np.uint32(16) | seq[at + 1]
        every = seq.astype(np.uint32) << np.uint32(16)
        every[:-1] |= seq[1:]
        return at, every[at]

    def replace(self) -> np.ndarray | None:
        """One round; the pairs of its rules, or None at the end. A rule is made only if it is used MIN_USES times."""
        at, keys = self.pairs()
        ordered = np.sort(keys)
        if not len(ordered):
            return None
        edge = np.r_[0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, len(ordered)]
        uses = np.diff(edge)
        frequent = np.flatnonzero(uses >= MIN_USES)
        uses, frequent = uses[frequent], ordered[edge[frequent]]
        if not len(frequent):
            return None
        table = PairTable(frequent)
        slots = table.slots(keys)
        floor = max(MIN_USES, int(uses.max() * ROUND_SHARE))
        while self.next_rule < SYMBOLS:
            often = np.flatnonzero(uses >= floor)
            by_use = often[np.argsort(-uses[often], kind="stable")][: SYMBOLS - self.next_rule]
            chosen = frequent[by_use]
            code = table.codes(slots, chosen)
            where, rule = occurrences(at, *table.found(keys, code))
            used = np.bincount(rule, minlength=len(chosen))
            pays = used >= MIN_USES
            if pays.any():
                take = pays[rule]
                number = np.cumsum(pays) - 1 + self.next_rule
                self.look[at] = code > 0
                self.merge(where[take], number[rule[take]])
                self.next_rule += int(pays.sum())
                return chosen[pays]
            if floor == MIN_USES:
                break
            # the most frequent pairs only overlap each other: look further down
            floor = max(MIN_USES, floor // 4)
        return None

    def merge(self, where: np.ndarray, symbols: np.ndarray) -> None:
        """Puts ``symbols`` in place of the pairs at ``where`` (ascending); their places and those before are looked at."""
        self.seq[where] = symbols
        keep = np.ones(len(self.seq), bool)
        keep[where + 1] = False
        self.look[where] = True
        self.look[where[where > 0] - 1] = True
        self.seq, self.look = self.seq[keep], self.look[keep]
        self.offs = self.offs - np.searchsorted(where, self.offs)


class PairTable:
    """Which of many pairs are frequent, and which of them are chosen, by a table of hashes.

    Codes: 0 a rare pair; 1 maybe frequent; 2 + i maybe the i-th chosen pair.
    """

    def __init__(self, frequent: np.ndarray):
        bits = min(PAIR_BITS, (SLOTS * len(frequent)).bit_length())
        self.shift = np.uint32(32 - bits)
        self.base = np.zeros(1 << bits, np.uint16)
        self.base[self.slots(frequent)] = 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> self.shift

    def codes(self, slots: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Code of the pair in each of the slots."""
        table, own = self.base.copy(), self.slots(chosen)
        table[own] = np.arange(2, 2 + len(chosen))
        self.chosen = chosen
        #: chosen pairs whose slot another one has
        self.hidden = np.flatnonzero(table[own] != np.arange(2, 2 + len(chosen)))
        return table[slots]

    def found(self, keys: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the keys that are chosen pairs, and of the pairs."""
        spot = np.flatnonzero(code > 1)
        pair, own = code[spot].astype(np.intp) - 2, keys[spot]
        hit = self.chosen[pair] == own
        if len(self.hidden):
            other = np.flatnonzero(~hit)
            by_key = self.hidden[np.argsort(self.chosen[self.hidden])]
            near = by_key[np.minimum(np.searchsorted(self.chosen[by_key], own[other]), len(by_key) - 1)]
            same = self.chosen[near] == own[other]
            hit[other[same]] = True
            pair[other[same]] = near[same]
        return spot[hit], pair[hit]


def occurrences(at: np.ndarray, spot: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which chosen pairs (most frequent first) are replaced, and the index of each one's pair.

    ``at[spot]``, ``rule``: positions of the chosen pairs, ascending, and which pair is there.  Of overlapping
    pairs the more frequent wins; a run of equal symbols pairs from its start.
    """
    where = at[spot]
    keep = np.ones(len(where), bool)
    touch = np.flatnonzero(where[1:] - where[:-1] == 1)  # these overlap the next one
    left, right = rule[touch], rule[touch + 1]
    same = touch[left == right]
    if len(same):
        # runs of one pair: only every second position is a candidate
        n = np.arange(len(same))
        start = np.maximum.accumulate(np.where(np.r_[True, same[1:] - same[:-1] > 1], n, 0))
        keep[same[(n - start) % 2 == 0] + 1] = False
        both = keep[touch] & keep[touch + 1]
        touch, left, right = touch[both], left[both], right[both]
    keep[touch + (left < right)] = False
    return where[keep], rule[keep]


def compress(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, symbol offset of each document, rules as (n, 2), expansion length of each rule)."""
    rounds = Rounds(np.concatenate(ids).astype(np.uint32), np.r_[0, np.cumsum([len(x) for x in ids], dtype=np.int64)])
    if len(rounds.seq) and int(rounds.seq.max()) >= FIRST_RULE:
        raise ValueError(f"token id {int(rounds.seq.max())}: ids must be below {FIRST_RULE}, the first nonterminal")
    rules, before = [], 0
    while len(rounds.seq) and (not rules or before - len(rounds.seq) >= LAST_SHARE * before):
        before = len(rounds.seq)
        if (made := rounds.replace()) is None:
            break
        rules.append(np.stack([made >> np.uint32(16), made & np.uint32(0xFFFF)], axis=1))
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return rounds.seq, rounds.offs, table, expansion_lengths(rules)


def expansion_lengths(rules: list[np.ndarray]) -> np.ndarray:
    """Ids that each rule expands to; ``rules``: those of each round, which refer to rules of earlier rounds only."""
    size, n = np.ones(SYMBOLS, np.uint32), FIRST_RULE
    for made in rules:
        size[n : n + len(made)] = size[made[:, 0]] + size[made[:, 1]]
        n += len(made)
    return size[FIRST_RULE:n]


def pack_shard(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    seq, offs, rules, lengths = compress(ids)
    body = [
        HEAD.pack(MAGIC, len(ids), len(rules), len(seq), FIRST_RULE, 0),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        offs.astype("<u4").tobytes(),
        np.array([len(x) for x in ids], "<u4").tobytes(),
        rules.astype("<u4").tobytes(),
        lengths.astype("<u4").tobytes(),
        seq.astype("<u2").tobytes(),
    ]
    return b"".join(body)


class Shard:
    """A payload read back."""

    def __init__(self, payload: bytes):
        magic, n_docs, n_rules, n_symbols, first, _ = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.first, at = first, HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        ids, none = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), none.tolist())]
        self.offsets, self.tokens = take("<u4", n_docs + 1), take("<u4", n_docs)
        self.rules, self.lengths = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        self.sequence = take("<u2", n_symbols)

    @cached_property
    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of every symbol in one array, and each symbol's start and length there."""
        ids = self.rules.ravel()
        # a rule refers to earlier ones only, so there are as many turns as rules stand in each other
        while len(inner := np.flatnonzero(ids >= self.first)):
            size = np.ones(len(ids), np.int64)
            size[inner] = 2
            upto = np.cumsum(size)
            pairs = self.rules[ids[inner] - self.first]
            out = np.empty(int(upto[-1]), "<u4")
            out[upto - 1] = ids
            out[upto[inner] - 2], out[upto[inner] - 1] = pairs[:, 0], pairs[:, 1]
            ids = out
        size = np.r_[np.ones(self.first, np.int64), self.lengths.astype(np.int64)]
        return np.r_[np.arange(self.first, dtype="<u4"), ids], np.cumsum(size) - size, size

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that ``symbols`` stand for."""
        flat, start, size = self.expansions
        n = size[symbols]
        upto = np.cumsum(n)
        return flat[np.arange(int(n.sum())) + np.repeat(start[symbols] - (upto - n), n)]

    def all_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the whole shard and the documents' offsets in them."""
        return self.expand(self.sequence), np.r_[0, np.cumsum(self.tokens.astype(np.int64))]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.sequence[self.offsets[k] : self.offsets[k + 1]])

    def decode_range(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document k, expanding only the symbols that hold them."""
        symbols = self.sequence[self.offsets[k] : self.offsets[k + 1]].astype(np.int64)
        size = np.ones(len(symbols), np.int64)
        inner = symbols >= self.first
        size[inner] = self.lengths[symbols[inner] - self.first]
        upto = np.r_[0, np.cumsum(size)]
        lo = int(np.searchsorted(upto, start, "right")) - 1
        hi = int(np.searchsorted(upto, stop, "left"))
        return self.expand(symbols[lo:hi])[start - upto[lo] : stop - upto[lo]]


def shard_maker(path: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        end = np.array([END_ID], np.int32)
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        size, k = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, ids, size, k
            columns = [[part], [k], [len(docs)], [size], [pack_shard(docs, ids)]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            docs, ids, size, k = [], [], 0, k + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "shard", "n_docs", "n_ids", "payload"]
            )

        for b in batches:
            for doc, own in zip(b.column(0).to_pylist(), tokens.encoder(path, SEGMENTS).encode(b.column(1))):
                docs.append(doc)
                ids.append(np.concatenate((own, end)))
                size += len(ids[-1])
                if size >= SHARD_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_shards(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> None:
    """Writes the shards of ``docs`` to the folder ``out``, in ascending id order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = F.col("doc_id").asc_nulls_last()
    rows = rows.repartitionByRange(order).sortWithinPartitions(order)
    shards = rows.mapInArrow(
        shard_maker(path or tokens.vocabulary(VOCABULARY)), "part long, shard long, n_docs long, n_ids long, payload binary"
    )
    shards.write.parquet(out)


def _unpack(batches):
    for b in batches:
        for first, payload in zip(b.column(0).to_pylist(), b.column(1)):
            shard = Shard(payload.as_py())
            ids, at = shard.all_ids()
            crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard.doc_ids, pa.int64()),
                    pa.array(first + at[:-1]),
                    pa.array(np.diff(at)),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Where a shard starts is a running sum over the shards of its partition and
    over the partitions, of the narrow counts alone.
    """
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    per_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(starts, "part")
    # stored: its size is known when the join is planned, so payloads move only where it is large
    first = stored(placed.select("part", "shard", (F.col("part_start") + F.col("inner")).alias("first")), "shard-starts")
    whole = shards.join(first, ["part", "shard"]).select("first", "payload")
    return whole.mapInArrow(_unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes ``docs`` as shards in the shared folder and reads the files back."""
    spark = docs.sparkSession
    out = new_path(spark, "token-shards")
    write_shards(docs, out, **options)
    return read_shards(spark, out)
