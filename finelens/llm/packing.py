"""Best-fit packing of token sequences with certified bin counts.

Documents become pieces of at most ``CAPACITY`` tokens.  Pieces are dealt by
hash to partitions of bounded size; each runs best-fit decreasing and
certifies its bin count by dual-feasible-function lower bounds.  Where the
count exceeds the bound, the partition releases its emptiest bins, as many as
their free room covers the gap; released documents of ``FAN_IN`` partitions
meet in one partition of the next round and best-fit decreasing runs again,
until one partition is left.  Only released documents move.

Defined results
---------------
* null text is the empty text: one piece that holds the end token alone;
* repeated rows and rows with null ids are packed as documents of their own;
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finelens.llm import tokens
from finelens.llm.common import stored

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Pieces in one partition of the first round.
PIECES = 65_536
#: Partitions whose released documents meet in the next round.
FAN_IN = 16
#: Bits of a sequence id that name the partition and the bin in it; more of either is an error.
PARTITION_BITS, BIN_BITS = 28, 20
#: Rounding functions u(k) tried for the lower bound.
MAX_K = 64

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_maker(path: str, with_ids: bool):
    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            docs = b.column(0).to_pylist()
            for doc, ids in zip(docs, tokens.encoder(path).encode(b.column(1))):
                ids = np.r_[ids, END_ID].astype("<u4")
                for k in range(0, len(ids), CAPACITY):
                    part = ids[k : k + CAPACITY]
                    rows.append((doc, k // CAPACITY, k, len(part), zlib.crc32(part.tobytes()), part))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, with_ids: bool = False) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(piece_maker(path, with_ids), PIECE + (", ids array<int>" if with_ids else ""))


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> float:
    """Dual-feasible-function bound on the bins for ``counts[x]`` items of each length x.

    The largest of: the total over the capacity; the functions that drop items
    shorter than e and round items longer than capacity - e up to a whole bin,
    for every e; and the rounding functions u(k).
    """
    x = np.arange(capacity + 1)
    number, total = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * x)]
    e = np.arange(capacity // 2 + 1)
    big = number[-1] - number[capacity - e + 1]
    mid = total[capacity - e + 1] - total[e]
    best = float((big + mid / capacity).max())
    for k in range(1, MAX_K + 1):
        whole = (k + 1) * x % capacity == 0
        u = np.where(whole, x / capacity, (k + 1) * x // capacity / k)
        best = max(best, float((u * counts).sum()))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the free room of every bin.

    Bins are kept by free room; one big integer has a bit for each room that
    some bin has, so the tightest fit is its lowest bit at or above the length.
    """
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, free = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = mask >> n
        if fit:
            room = n + ((fit & -fit).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bin_of[i], offset[i] = b, capacity - room
        left = room - n
        free[b] = left
        if not by_room[left]:
            mask |= 1 << left
        by_room[left].append(b)
    return bin_of, offset, np.array(free, np.int64)


def pack_partition(table: pa.Table) -> pa.Table:
    """Packs the items of one partition; rows of released bins are marked."""
    lengths = table["length"].to_numpy()
    bin_of, offset, free = best_fit_decreasing(lengths)
    if len(free) > 1 << BIN_BITS:
        raise ValueError(f"{len(free)} bins in a partition: sequence ids have room for {1 << BIN_BITS}")
    bound = lower_bound(np.bincount(lengths, minlength=CAPACITY + 1))
    gap = len(free) - bound
    release = np.zeros(len(free), bool)
    if gap > 1e-9:
        order = np.argsort(-free, kind="stable")
        enough = int(np.searchsorted(np.cumsum(free[order]), gap * CAPACITY - 1e-6)) + 1
        release[order[:enough]] = True
    extra = {
        "bin": pa.array(bin_of),
        "offset": pa.array(offset),
        "released": pa.array(release[bin_of]),
        "bound": pa.array(np.full(len(lengths), bound)),
    }
    out = table.select([c for c in table.column_names if c not in extra])
    for name, values in extra.items():
        out = out.append_column(name, values)
    return out


def pack(items: DataFrame) -> DataFrame:
    """Places stored ``items`` (PIECE columns and any others): adds sequence_id and offset."""
    n = items.count()
    width = max(1, -(-n // PIECES))
    if width > 1 << PARTITION_BITS:
        raise ValueError(f"{width} partitions: sequence ids have room for {1 << PARTITION_BITS}")
    schema = T.StructType([*items.schema.fields, T.StructField("pid", T.LongType())])
    packed = T.StructType(
        [
            *schema.fields,
            T.StructField("bin", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("released", T.BooleanType()),
            T.StructField("bound", T.DoubleType()),
        ]
    )
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(width))
    todo, done, level = items.withColumn("pid", spread), [], 0
    while True:
        level_rows = stored(todo.groupBy("pid").applyInArrow(pack_partition, packed), f"packed-{level}")
        last = width == 1
        settled = level_rows if last else level_rows.where("not released")
        # below 2**53, exact as a double too: round, partition, bin
        sequence = F.lit(level << (PARTITION_BITS + BIN_BITS)) + F.shiftleft("pid", BIN_BITS) + F.col("bin")
        done.append(settled.withColumn("sequence_id", sequence).drop("pid", "bin", "released", "bound"))
        if last:
            break
        todo = level_rows.where("released").withColumn("pid", F.floor(F.col("pid") / FAN_IN)).select(*schema.names)
        width, level = -(-width // FAN_IN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def packed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    items = stored(pieces(docs, id_col, text_col, path or tokens.vocabulary(VOCABULARY), with_ids), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    return pack(items).select(*columns)


def certificate(packed: DataFrame) -> dict[str, float]:
    """Sequences used and the lower bound over all pieces (from the histogram of lengths)."""
    rows = packed.groupBy("length").count().collect()  # at most CAPACITY rows
    counts = np.zeros(CAPACITY + 1)
    for r in rows:
        counts[r["length"]] = r["count"]
    return {"sequences": packed.select("sequence_id").distinct().count(), "bound": float(np.ceil(lower_bound(counts) - 1e-9))}
