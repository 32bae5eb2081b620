"""K-d tree sharding: recursive splits at distributed weighted medians (native).

A document is a point whose coordinates are its metadata (language, source,
size) and whose weight is its size in bytes.  A node of the tree that must
become ``k`` shards is split along its widest dimension (range inside the node
over range of the whole table) at the weight quantile k//2 : k; nodes of one
shard are leaves.  ``target_bytes`` sets the number of shards by the size
wanted of a leaf.

No row moves while the tree is built.  All nodes of a level are split at once:
histograms of at most ``HISTOGRAM`` buckets (partial sums in every task) locate
the bucket in which the weight crosses the quantile, and only the rows of that
bucket are looked at again, until one row is left: first by the coordinate,
then, among rows that share it, by id, checksum and row number.  So a value
that a third of all rows share is cut inside, and each cut is exact to half a
document.  What the driver holds is the histogram of a level, whatever the
input.  The tree is then a column expression over metadata.

Slots are places in the order (id, checksum) of a shard: rows are dealt by
ranges of (shard, id, checksum, row number), and the ranges' counts are added
up; neither a shard nor an id is ever in one task.

Defined results
---------------
* null text has size 1 and checksum 0; null language or source counts as empty;
* equal texts are not kept together: the bytes law decides (a group of copies
  may be larger than a shard);
* rows without id sort first; repeated rows are told apart by their row
  numbers, which are as good as each other;
* a very long text is one point: a shard holds at least its bytes;
* an empty table gives an empty result; fewer documents than shards leave
  shards empty; further columns are ignored by ``shard_rows`` and kept by
  ``with_shard``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finelens.llm.common import let, stored

SHARDS = 16
#: Buckets of all nodes of a level together, the most that a pass brings to the driver.
HISTOGRAM = 1 << 14
#: Rows of a range in which slots are counted.
SLOT_ROWS = 1 << 16
#: Bytes of a string that make its coordinate.
STRING_BYTES = 6

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: The order of rows that share a coordinate; the row number makes it total.
TIES = ("__id", "__crc", "__uid")


def string_coordinate(value: Column) -> Column:
    """The first bytes of a string as a number: byte order is kept, null is empty."""
    digits = F.substring(F.hex(F.coalesce(value, F.lit(""))), 1, 2 * STRING_BYTES)
    return F.conv(F.rpad(digits, 2 * STRING_BYTES, "0"), 16, 10).cast("long")


def text_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def document_dims(lang: str = "lang", source: str = "source", text: str = "text") -> list[Column]:
    return [string_coordinate(F.col(lang)), string_coordinate(F.col(source)), text_size(F.col(text))]


@dataclass
class Tree:
    """Levels of splits: for every node of a level its dimension, cut key and children."""

    levels: list[dict] = field(default_factory=list)
    shards: list[int] = field(default_factory=lambda: [0])  # of the nodes below the last level

    def node(self) -> Column:
        """The node of a row below the last level, from its coordinates and ties."""
        at = F.lit(0)
        for level in self.levels:
            at = let(at, partial(_child, level))
        return at


def _pick(values: list[int], at: Column) -> Column:
    return F.get(F.lit(values).cast("array<bigint>"), at)


def _coordinate(dims: list[int], at: Column) -> Column:
    used = F.array(*[F.col(f"__d{d}") for d in range(max(dims) + 1)])
    return F.get(used, _pick(dims, at).cast("int"))


def _child(level: dict, node: Column) -> Column:
    key = F.struct(_coordinate(level["dim"], node).alias("c"), *[F.col(t) for t in TIES])
    cut = F.struct(*[_pick(level["cut"][j], node).alias(n) for j, n in enumerate(("c", *TIES))])
    return _pick(level["child"], 2 * node + (key > cut).cast("int")).cast("int")


def _point_columns(dims: list[Column], id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [
        F.col(id_col).alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("__id"),
        F.crc32(text.cast("binary")).alias("__crc"),
        text_size(F.col(text_col)).alias("size"),
        F.monotonically_increasing_id().alias("__uid"),
        *[F.coalesce(d.cast("long"), F.lit(0)).alias(f"__d{j}") for j, d in enumerate(dims)],
    ]


def points_of(docs: DataFrame, dims: list[Column], id_col: str, text_col: str) -> DataFrame:
    """One narrow row per document: id, size, checksum, coordinates, row number."""
    return docs.select(*_point_columns(dims, id_col, text_col))


def _ranges(rows: DataFrame, n_dims: int) -> dict[int, dict]:
    """Bytes, rows and the range of every dimension, by node."""
    sums = [F.sum("size").alias("bytes"), F.count("*").alias("rows")]
    for d in range(n_dims):
        sums += [F.min(f"__d{d}").alias(f"lo{d}"), F.max(f"__d{d}").alias(f"hi{d}")]
    return {r["__node"]: r.asDict() for r in rows.groupBy("__node").agg(*sums).collect()}


@dataclass
class Search:
    """The hunt for one node's cut: rows that match ``fixed`` and lie in [lo, hi] of key part ``part``."""

    dim: int
    need: int  # times k: bytes still to go left
    k: int
    lo: int
    hi: int
    part: int = 0
    fixed: list[int] = field(default_factory=list)
    cut: list[int] | None = None

    def settle(self, value: int, below: bool) -> None:
        """Cut right before (``below``) or behind the rows of this value."""
        rest = 3 - self.part
        if below and not rest:
            value -= 1
        self.cut = [*self.fixed, value, *[LOWEST if below else HIGHEST] * rest]

    def narrow(self, buckets: list) -> None:
        """Take whole buckets while they fit; go into the one that does not."""
        last = None
        for b in sorted(buckets, key=lambda b: b["lo"]):
            if b["bytes"] * self.k <= self.need:
                self.need -= b["bytes"] * self.k
                last = b
                continue
            if b["rows"] == 1:
                self.settle(b["hi"], below=2 * self.need < b["bytes"] * self.k)
            elif b["lo"] < b["hi"]:
                self.lo, self.hi = b["lo"], b["hi"]
            else:
                self.fixed.append(b["lo"])
                self.part, self.lo, self.hi = self.part + 1, b["next_lo"], b["next_hi"]
            return
        self.settle(last["hi"], below=False)


def _histograms(rows: DataFrame, hunts: dict[int, Search], n_nodes: int) -> dict[int, list]:
    """One pass over the rows that the open hunts still look at: weights by bucket."""
    bits = max(2, (HISTOGRAM // len(hunts)).bit_length() - 1)
    table: dict[str, list[int]] = {n: [0] * n_nodes for n in ("dim", "part", "lo", "hi", "shift", "f0", "f1", "f2")}
    table["part"] = [-1] * n_nodes
    for node, h in hunts.items():
        table["dim"][node], table["part"][node], table["lo"][node], table["hi"][node] = h.dim, h.part, h.lo, h.hi
        table["shift"][node] = max(0, (h.hi - h.lo).bit_length() - bits)
        for j, v in enumerate(h.fixed):
            table[f"f{j}"][node] = v
    at = F.col("__node")
    pick = {n: _pick(v, at) for n, v in table.items()}
    key = F.array(_coordinate(table["dim"], at), *[F.col(t) for t in TIES], F.lit(0).cast("long"))
    part = pick["part"].cast("int")
    seen = rows.where(part >= 0).select(
        "__node",
        "size",
        F.struct(part.alias("part"), pick["lo"].alias("lo"), pick["hi"].alias("hi"), pick["shift"].cast("int").alias("shift")).alias("h"),
        key.alias("key"),
        *[pick[f"f{j}"].alias(f"f{j}") for j in range(3)],
    )
    same = F.lit(True)
    for j in range(3):
        same &= (F.col("h.part") <= j) | (F.col("key")[j] == F.col(f"f{j}"))
    seen = seen.where(same).select(
        "__node", "size", "h", F.get("key", F.col("h.part")).alias("v"), F.get("key", F.col("h.part") + 1).alias("nv")
    )
    found = (
        seen.where((F.col("v") >= F.col("h.lo")) & (F.col("v") <= F.col("h.hi")))
        .groupBy("__node", F.call_function("shiftright", F.col("v"), F.col("h.shift")).alias("bucket"))
        .agg(
            F.sum("size").alias("bytes"),
            F.count("*").alias("rows"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
            F.min("nv").alias("next_lo"),
            F.max("nv").alias("next_hi"),
        )
        .collect()
    )
    out: dict[int, list] = {}
    for r in found:
        out.setdefault(r["__node"], []).append(r)
    return out


def build_tree(
    points: DataFrame, n_dims: int, shards: int | None = SHARDS, target_bytes: int | None = None
) -> tuple[Tree, DataFrame]:
    """Split until every leaf is one shard; the tree, and the narrow rows with their node.

    The narrow rows are written again after each level, with the node they fell into.
    """
    tree = Tree()
    rows = stored(points.withColumn("__node", F.lit(0)), "kd-level0")
    whole = _ranges(rows, n_dims).get(0)
    if whole is None:
        return tree, rows
    k = -(-whole["bytes"] // target_bytes) if target_bytes else shards
    nodes = [(0, k)]  # first shard, number of shards
    stats = {0: whole}
    while any(k > 1 for _, k in nodes):
        stats = stats if not tree.levels else _ranges(rows, n_dims)
        hunts = {}
        for node, (_, k) in enumerate(nodes):
            if k > 1 and node in stats:
                s = stats[node]
                width = [
                    float(s[f"hi{d}"] - s[f"lo{d}"]) / float(max(1, whole[f"hi{d}"] - whole[f"lo{d}"])) for d in range(n_dims)
                ]
                d = max(range(n_dims), key=lambda d: (width[d], -d))
                hunts[node] = Search(d, s["bytes"] * (k // 2), k, s[f"lo{d}"], s[f"hi{d}"])
        while live := {node: h for node, h in hunts.items() if h.cut is None}:
            found = _histograms(rows, live, len(nodes))
            for node, h in live.items():
                h.narrow(found[node])
        level = {"dim": [], "cut": [[], [], [], []], "child": []}
        below = []
        for node, (first, k) in enumerate(nodes):
            h = hunts.get(node)
            level["dim"].append(h.dim if h else 0)
            for j in range(4):
                level["cut"][j].append(h.cut[j] if h else HIGHEST)
            level["child"] += [len(below), len(below) + (k > 1)]
            below += [(first, k // 2), (first + k // 2, k - k // 2)] if k > 1 else [(first, k)]
        tree.levels.append(level)
        rows = stored(rows.withColumn("__node", _child(level, F.col("__node"))), f"kd-level{len(tree.levels)}")
        nodes = below
    tree.shards = [first for first, _ in nodes]
    return tree, rows


def shard_rows(
    docs: DataFrame,
    dims: list[Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = SHARDS,
    target_bytes: int | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    dims = dims or document_dims(text=text_col)
    tree, points = build_tree(points_of(docs, dims, id_col, text_col), len(dims), shards, target_bytes)
    placed = points.withColumn("shard", _pick(tree.shards, F.col("__node")).cast("int"))
    order = ["shard", *TIES]
    n = points.count() // SLOT_ROWS + points.sparkSession.sparkContext.defaultParallelism
    rows = stored(
        placed.select("id", "size", *order)
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("id", "size", "__crc", "shard", F.monotonically_increasing_id().alias("at")),
        "kd-ranges",
    ).withColumn("range", F.shiftright("at", 33))
    counts = rows.groupBy("shard", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(starts, ["shard", "range"]).select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("__crc").alias("text_crc32"),
        "shard",
        (F.col("at") - F.col("first") + F.col("before")).alias("slot"),
    )


def with_shard(
    docs: DataFrame,
    dims: list[Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = SHARDS,
    target_bytes: int | None = None,
    shard_col: str = "shard",
) -> DataFrame:
    """``docs`` and the shard of each row, by the tree's expression: no row moves.

    The new column is named ``shard_col``, with underscores behind it while the input has such a column.
    """
    dims = dims or document_dims(text=text_col)
    tree, _ = build_tree(points_of(docs, dims, id_col, text_col), len(dims), shards, target_bytes)
    while shard_col.lower() in [c.lower() for c in docs.columns]:
        shard_col += "_"
    # the input's columns travel in one struct, so none of their names meets a name used here
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_in")
    keyed = docs.select(whole, *_point_columns(dims, id_col, text_col))
    # a select of its own: beside aliases of the input's names, lambdas would read those (lateral aliases)
    placed = keyed.select("row_in", _pick(tree.shards, tree.node()).cast("int").alias("placed"))
    return placed.select(*[F.col("row_in").getField(c).alias(c) for c in docs.columns], F.col("placed").alias(shard_col))
