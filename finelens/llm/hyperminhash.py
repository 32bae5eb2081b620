"""Near-duplicate detection with HyperMinHash registers.

A document's set of distinct shingles (two words by default, ``width``) is hashed once; the top bits
choose one of ``K`` buckets, and of the smallest remainder in each bucket only
the number of leading zeros (6 bits) and the next ``R`` = 10 mantissa bits are
stored.  Empty buckets of sparse sets borrow from a filled bucket picked by a
fixed random order of their own (optimal densification), so a register agrees
with probability J at any set size.  ``BANDS`` x ``ROWS`` registers form the
band keys: a pair at J = 0.8 shares a band but for 3 in a million.

Work, without all pairs of a group:

1. equal sets fall into one class (digest), its smallest doc_id stands for it;
2. every bucket elects its smallest member as hub; (member, hub) pairs pass the
   collision-corrected estimate and are then verified on the full sets; the
   verified links are contracted to components;
3. only buckets of three and more members that still hold several components
   are searched exhaustively: members outside the bucket's largest component
   meet all members of other components, in blocks of bounded size.  Inside a
   block, sets of up to ``SMALL`` shingles are compared in full and joined
   as links are found, so a block hands out fewer links than it has
   components; of pairs with a larger set, the likeliest few for each two components
   are verified on the full sets, and more of them only where these fail.  Links
   then join components, not documents.  A group of copies is
   thus never expanded into its pairs, and no bucket member is left out.

Defined results
---------------
* null or blank text: empty set, linked with nothing, its own component;
* a text of fewer words than a shingle is one shingle of its own; repeated rows share a component;
* ``near_groups``: rows of one doc_id are one document: a link of any of them
  holds for all; rows without doc_id join the class of their text but never name
  one; a class of such rows alone has a null component and is not kept;
* ``keep_one_of_each`` works on texts instead of ids and keeps all columns, whatever their names;
* sets of ``SMALL`` shingles and one more differ in how they are searched, not in what links them;
* very long texts are hashed whole; of a longer set than ``SMALL`` only registers travel in the search;
* an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finelens.llm import wordhash as W
from finelens.llm.common import plain_names, restored, stored

K, R = 256, 10
BANDS, ROWS = 42, 6
#: Words of a shingle, where the caller names no other width.
WIDTH = 2
#: A link: 100 * |A and B| >= LINK_PCT * |A or B|.
LINK_PCT = 80
#: The estimate rules a pair out only beyond so many standard errors.
SIGMAS = 5.0
#: Sets of up to SMALL shingles have too few filled buckets for a sharp estimate; in the
#: exhaustive search they carry all their hashes and are compared in full at once.
SMALL = 512
#: Likeliest pairs of larger sets that are verified for two components of a bucket, round by round; None: all.
QUOTAS = (16, None)
#: Ids hash to so many slots; a broadcast of slots is bounded by it whatever the input.
SLOTS = 1 << 20
#: Bucket members in one block of the exhaustive search.
BLOCK = 4096

#: rank[j, b]: the order in which empty bucket j tries the buckets b.
_RANK = np.argsort(np.random.default_rng(20240229).random((K, K)), axis=1).argsort(axis=1).astype(np.uint8)

SKETCH_SCHEMA = "node long, n_shingles long, digest binary, regs binary"


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of every row's text (A-Z lower-cased)."""
    data, offsets = W.text_bytes(column)
    for _, _, raw, offs in W.slices(data, offsets):
        low = W.LOWER[raw]
        starts, ends, at = W.bounds(low, offs)
        h = W.span_hashes(W.prefix(low), starts, ends)
        spans = _spans(h, width)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            short = b - a < width
            yield W.mix(_spans(h[a:b], b - a) + np.uint64(0x1C69B3F74AC4AE35)) if short else np.unique(spans[a : b - width + 1])


def _spans(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbours of ``h``; none where there are fewer."""
    n = max(len(h) - width + 1, 0)
    out = h[:n]
    for k in range(1, width):
        out = W.mix(out * np.uint64(0x9FB21C651E98DF25) + (h[k : k + n] ^ np.uint64(0x3C79AC492BA7B653)))
    return out


def registers(u: np.ndarray) -> np.ndarray:
    """K packed registers (leading zeros << R | mantissa) of a sorted non-empty hash set."""
    bucket = (u >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    filled = bucket[first]
    rest = (u[first] << np.uint64(8)) >> np.uint64(11)  # 53 bits, exact as a double
    zeros = 53 - np.frexp(rest.astype(np.float64))[1].astype(np.uint64)
    mantissa = ((rest << np.uint64(11)) << (zeros + np.uint64(1))) >> np.uint64(64 - R)
    packed = np.zeros(K, np.uint16)
    packed[filled] = (zeros << np.uint64(R) | mantissa).astype(np.uint16)
    if len(filled) < K:
        empty = np.setdiff1d(np.arange(K), filled, assume_unique=True)
        packed[empty] = packed[filled[_RANK[np.ix_(empty, filled)].argmin(axis=1)]]
    return packed


def expected_collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that unrelated sets of n and m elements agree in a register.

    The minima are near exponential with rates n/K and m/K; within an octave
    of leading zeros the 2**R mantissa cells have equal width, so the sum over
    cells is the width times the integral of the product of the densities.
    """
    a, b = (np.maximum(np.asarray(x, float), K) / K for x in (n, m))
    z = np.arange(54)[:, None]
    hi, lo = 2.0**-z, 2.0 ** -(z + 1.0)
    width = lo / 2**R
    both = a + b
    return (width * a * b / both * (np.exp(-both * lo) - np.exp(-both * hi))).sum(axis=0)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of the register rows ``x`` and ``y``."""
    agree = (x == y).mean(axis=1)
    c = expected_collision(n, m)
    return (agree - c) / (1 - c)


def may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Pairs of register rows that the estimate does not rule out."""
    j = LINK_PCT / 100
    size_ok = 100 * np.minimum(n, m) >= LINK_PCT * np.maximum(n, m)
    filled = K * -np.expm1(-np.minimum(n, m) / K)  # borrowed registers add no evidence
    return size_ok & (estimate(x, y, n, m) >= j - SIGMAS * np.sqrt(j * (1 - j) / filled))


def small_links(one: bytes, others: list[bytes]) -> np.ndarray:
    """Whether a small set is linked with each of ``others``, also small: exact, on their full sets of hashes."""
    s = np.frombuffer(one, np.uint64)
    sizes = np.array([len(o) // 8 for o in others])
    flat = np.frombuffer(b"".join(others), np.uint64)
    hit = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
    both = np.add.reduceat(hit.astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
    return 100 * both >= LINK_PCT * (len(s) + sizes - both)


def _sketch(batches, width):
    for b in batches:
        n, digest, regs = [], [], []
        for u in shingle_sets(b.column(1), width):
            n.append(len(u))
            digest.append(blake2b(u.tobytes(), digest_size=16).digest())
            regs.append(registers(u).tobytes() if len(u) else None)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())],
            ["node", "n_shingles", "digest", "regs"],
        )


def _small(batches, width):
    """(node, small) of (node, text): a small set's hashes, null for a larger set."""
    for b in batches:
        sets = [u.tobytes() if 0 < len(u) <= SMALL else None for u in shingle_sets(b.column(1), width)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "small"])


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """(node, n_shingles, digest, regs) of ``texts`` (node, text)."""
    return texts.mapInArrow(partial(_sketch, width=width), SKETCH_SCHEMA)


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, K)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(rows, BANDS) 64-bit keys of the register bands."""
    part = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), BANDS))
    for r in range(ROWS):
        key = W.mix(key * W.BASE + part[:, :, r])
    return key


def _bands(batches):
    for b in batches:
        if b.num_rows:
            keys = band_keys(_regs(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["key", "node"]
            )


def _estimated(batches):
    """Keeps (a, b) of rows a, b, na, nb, ra, rb that may be linked."""
    for b in batches:
        if b.num_rows:
            ok = may_link(_regs(b.column(4)), _regs(b.column(5)), b.column(2).to_numpy(), b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(ok)) for k in (0, 1)], ["a", "b"])


def _sets(batches, width):
    for b in batches:
        sets = list(shingle_sets(b.column(1), width))
        offs = np.r_[0, np.cumsum([len(u) for u in sets])].astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], ["node", "shingles"]
        )


class Forest:
    """Components of one block, joined as links are found."""

    def __init__(self, comp: np.ndarray):
        names, self.of = np.unique(comp, return_inverse=True)
        self.parent = np.arange(len(names))

    def roots(self) -> np.ndarray:
        """The root of every row."""
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent[self.of]

    def join(self, roots: np.ndarray) -> None:
        self.parent[roots] = roots.min()


def _residual_pairs(table: pa.Table, quota: int | None, exact: bool) -> pa.Table:
    """Links and candidates of one block of a bucket: minority rows against all rows of other components.

    Small sets are compared in full: of the links found, those are given that join components of the
    block which no earlier one has joined, fewer than there are components.  Of pairs with a larger set that
    the estimate does not rule out, the ``quota`` likeliest are given for each two components (None: all);
    ``more`` says that there are further ones.  A pair that shares several bands belongs to the first.
    ``exact``: compare small sets too (they are settled after the first round).
    """
    regs, comp, node, n = _regs(table["regs"]), table["comp"].to_numpy(), table["node"].to_numpy(), table["n"].to_numpy()
    side, hub, minor = table["side"].to_numpy(), table["hub"].to_numpy(), table["minor"].to_numpy()
    small = table["small"].to_pylist()
    has_small = np.array([x is not None for x in small])
    keys, key = band_keys(regs), np.int64(table["key"][0].as_py()).view(np.uint64)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    forest = Forest(comp)
    root = forest.roots()
    links, maybe = [], []
    for i in left:
        # both minor: the pair occurs from either side, keep one
        js = right[(root[right] != root[i]) & (node[right] != hub[right]) & ~(minor[right] & (node[right] < node[i]))]
        js = js[100 * np.minimum(n[js], n[i]) >= LINK_PCT * np.maximum(n[js], n[i])]
        if not len(js) or node[i] == hub[i]:
            continue
        same = keys[js] == keys[i]
        js = js[keys[i][same.argmax(axis=1)] == key]
        both_small = has_small[js] & has_small[i]
        whole = js[both_small] if exact else js[:0]
        if len(whole):
            whole = whole[small_links(small[i], [small[j] for j in whole])]
            joined, first = np.unique(root[whole], return_index=True)
            links += [(node[i], node[whole[f]]) for f in first]
            if len(joined):
                forest.join(np.r_[joined, root[i]])
                root = forest.roots()
        js = js[~both_small]
        js = js[root[js] != root[i]]
        if len(js):
            x = np.broadcast_to(regs[i], (len(js), K))
            js = js[may_link(x, regs[js], np.full(len(js), n[i]), n[js])]
            maybe += [(i, j, (regs[i] == regs[j]).sum()) for j in js]
    out = [(a, b, True, False) for a, b in links]
    by_pair: dict[tuple, list] = {}
    for i, j, agree in maybe:
        if root[i] != root[j]:
            by_pair.setdefault((min(root[i], root[j]), max(root[i], root[j])), []).append((-agree, node[i], node[j]))
    for found in by_pair.values():
        found.sort()
        out += [(a, b, False, quota is not None and len(found) > quota) for _, a, b in found[:quota]]
    columns = list(zip(*out)) or [[], [], [], []]
    low, high = (pa.array([f(a, b) for a, b in zip(columns[0], columns[1])], pa.int64()) for f in (min, max))
    return pa.table({"a": low, "b": high, "exact": pa.array(columns[2], pa.bool_()), "more": pa.array(columns[3], pa.bool_())})


def narrowed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``node`` is among ``ids`` (node).

    Ids are first compared by slot, against a broadcast of at most SLOTS
    numbers, so wide rows that nobody asks for are not shuffled; the rest is
    settled by an exact semi-join.
    """
    slot = F.pmod(F.xxhash64("node"), F.lit(SLOTS)).cast("int")
    slots = ids.select(slot.alias("__slot")).distinct()
    near = rows.withColumn("__slot", slot).join(F.broadcast(slots), "__slot", "left_semi").drop("__slot")
    return near.join(ids.select("node").distinct(), "node", "left_semi")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over ``links`` (a, b).

    Smallest-label exchange along the links with pointer jumping; every round
    is stored in the shared folder.
    """
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp"))
    labels = stored(labels, "labels")
    while True:
        near = (
            edges.join(labels, edges["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("comp").alias("near"))
        )
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")
        )
        root = labels.select(F.col("node").alias("r"), F.col("comp").alias("r_comp"))
        nxt = lower.join(root, lower["comp"] == root["r"], "left").select(
            "node", "was", F.least("comp", "r_comp").alias("comp")
        )
        nxt = stored(nxt, "labels")
        labels = nxt.select("node", "comp")
        if nxt.where("was <> comp").isEmpty():
            return labels


def ends_of(pairs: DataFrame) -> DataFrame:
    """(node): the distinct ends of ``pairs`` (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Those of the stored ``pairs`` (a, b) whose full shingle sets meet the threshold.

    ``docs`` holds (node, text) of the class representatives; only the texts
    that some pair names are hashed again.
    """
    named = stored(ends_of(pairs), "named")
    sets = stored(narrowed(docs, named).mapInArrow(partial(_sets, width=width), "node long, shingles array<long>"), "sets")
    sa = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(sa, "a")
        .join(sb, "b")
        .where(100 * both >= LINK_PCT * (F.size("sa") + F.size("sb") - both))
        .select("a", "b")
    )


def linked(sk: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(digest, component) of the non-empty sets of ``sk`` (node, n_shingles, digest, regs).

    ``texts`` holds (node, text); a component is named by its smallest node,
    and rows without a node join the class of their text but never name one.
    """
    nodes = (
        sk.where("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min("node").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("regs").alias("regs"))
    )
    nodes = stored(nodes, "classes")
    reps = nodes.where("node is not null").select("node", "n", "regs")
    bands = reps.select("node", "regs").mapInArrow(_bands, "key long, node long")
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1")
    rows = stored(bands.join(hubs, "key"), "buckets")

    star = rows.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    star = stored(star, "star-pairs")
    wide = narrowed(reps, stored(ends_of(star), "star-nodes"))
    ra, rb = (wide.select(F.col("node").alias(x), *[F.col(c).alias(c[0] + x) for c in ("n", "regs")]) for x in "ab")
    star = star.join(ra, "a").join(rb, "b").select("a", "b", "na", "nb", "ra", "rb")
    star = star.mapInArrow(_estimated, "a long, b long")
    links = stored(verified(stored(star, "star-estimated"), texts, width).distinct(), "star-links")
    comps = components(links)
    for k, quota in enumerate(QUOTAS):
        more, unsettled = residual_links(rows, reps, comps, texts, width, quota, exact=k == 0)
        comps = contracted(comps, more)
        if not unsettled:
            break
    return nodes.join(comps, "node", "left").select("digest", F.coalesce("comp", "node").alias("component"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    sk = stored(sketches(texts, width), "sketches")
    out = sk.join(linked(sk, texts, width), "digest", "left").withColumnRenamed("node", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def contracted(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after ``links`` (a, b) between nodes of different components.

    What is searched are edges between components, not between documents.
    """
    if links.isEmpty():
        return comps
    known = stored(
        comps.unionByName(ends_of(links).join(comps, "node", "left_anti").select("node", F.col("node").alias("comp"))), "components"
    )
    ca, cb = (known.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    edges = links.join(ca, "a").join(cb, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
    up = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("now"))
    return stored(known.join(up, "comp", "left").select("node", F.coalesce("now", "comp").alias("comp")), "components")


def residual_links(
    rows: DataFrame, reps: DataFrame, comps: DataFrame, texts: DataFrame, width: int, quota: int | None, exact: bool
) -> tuple[DataFrame, bool]:
    """Verified links between members of one bucket that lie in different components; whether pairs are left untried.

    (Pairs with the hub are settled.)  Every bucket is cut into blocks of at
    most BLOCK members by the members' hash; the rows outside the bucket's
    largest component, also in blocks, meet all blocks.
    """
    known = rows.where("size > 2").join(comps, "node", "left").select(
        "key", "node", "hub", F.coalesce("comp", "node").alias("comp")
    )
    per = known.groupBy("key", "comp").agg(F.count("*").alias("members"))
    top = per.groupBy("key").agg(
        F.max(F.struct("members", "comp")).alias("top"), F.sum("members").alias("size"), F.count("*").alias("n_comps")
    )
    top = top.where("n_comps > 1").select(
        "key",
        F.col("top.comp").alias("major"),
        F.ceil(F.col("size") / BLOCK).cast("int").alias("all_blocks"),
        F.ceil((F.col("size") - F.col("top.members")) / BLOCK).cast("int").alias("minor_blocks"),
    )
    spread = stored(known.join(top, "key").withColumn("minor", F.col("comp") != F.col("major")), "residual-buckets")
    h = F.xxhash64("node")
    left = spread.where("minor").select(
        "key", "node", "hub", "comp", "minor", F.lit(0).alias("side"),
        F.pmod(h, F.col("minor_blocks")).alias("p"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_blocks").cast("long") - 1)).alias("q"),
    )
    right = spread.select(
        "key", "node", "hub", "comp", "minor", F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("minor_blocks").cast("long") - 1)).alias("p"),
        F.pmod(h, F.col("all_blocks")).alias("q"),
    )
    asked = stored(spread.select("node").distinct(), "residual-nodes")
    small = narrowed(texts, asked).mapInArrow(partial(_small, width=width), "node long, small binary")
    # an id on several rows may have several sets; the estimate alone judges it
    small = small.groupBy("node").agg(F.when(F.count("*") == 1, F.any_value("small")).alias("small"))
    wide = stored(narrowed(reps, asked).join(small, "node"), "residual-sketches")
    members = left.unionByName(right).join(wide, "node")
    search = members.groupBy("key", "p", "q").applyInArrow(
        lambda table: _residual_pairs(table, quota, exact), "a long, b long, exact boolean, more boolean"
    )
    found = stored(search.distinct(), "residual-pairs")
    maybe = stored(found.where("not exact").groupBy("a", "b").agg(F.max("more").alias("more")), "residual-candidates")
    links = found.where("exact").select("a", "b")
    if maybe.isEmpty():
        return links, False
    sure = stored(verified(maybe.select("a", "b"), texts, width).distinct(), "residual-links")
    unsettled = not maybe.where("more").join(sure, ["a", "b"], "left_anti").isEmpty()
    return links.unionByName(sure).distinct(), unsettled


#: Bits of a text's first node number that are used; fewer only in tests, to make texts clash.
NODE_BITS = -1


def text_nodes(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``__node``, a 64-bit number of the text: equal for equal texts, different for different ones.

    The number is a hash.  Texts that share one are found by length and a second hash and are
    numbered anew until none do, so two texts never pass for one.
    """
    text = F.col(text_col)
    rows = rows.withColumn("__node", F.xxhash64(text).bitwiseAND(F.lit(NODE_BITS).cast("long")))
    seed = 0
    while True:
        seed += 1
        check = F.struct(F.length(text), F.xxhash64(F.lit(1 << 20), text))
        clash = rows.groupBy("__node").agg(F.min(check).alias("lo"), F.max(check).alias("hi")).where("lo <> hi")
        clash = stored(clash.select(F.col("__node").alias("__clash")), "node-clashes")
        if clash.isEmpty():
            return rows
        hit = rows.join(clash, F.col("__node") == F.col("__clash"), "left")
        rows = hit.withColumn(
            "__node", F.when(F.col("__clash").isNotNull(), F.xxhash64(F.lit(seed), text)).otherwise(F.col("__node"))
        ).drop("__clash")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id; rows without a word all stay.

    Rows are linked by their texts, never by their ids: rows that share an id are
    judged one by one, and rows without an id, which come after all others, like any
    other.  Of rows that share the smallest id, the text with the smallest 64-bit hash stays.
    """
    plain, names = plain_names(docs)
    id_col, text_col = names[id_col], names[text_col]
    keyed = text_nodes(plain, text_col)
    texts = keyed.select(F.col("__node").alias("node"), F.col(text_col).alias("text"))
    sk = stored(sketches(texts, width), "sketches")
    parts = sk.where("n_shingles > 0").join(linked(sk, texts, width), "digest").select("node", "component").distinct()
    ids = keyed.groupBy(F.col("__node").alias("node"), F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    rows = stored(ids.join(parts, "node"), "near-rows")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "node")
    first = rows.groupBy("component").agg(F.min(order).alias("first"), F.sum("n").alias("size")).where("size > 1")
    judged = rows.join(first.drop("size"), "component").withColumn("copy", order != F.col("first"))
    judged = stored(judged.where("copy or n > 1").select(F.struct("node", "id", "copy").alias("__j")), "near-copies")
    hit = (F.col("__node") == F.col("__j.node")) & F.col(id_col).eqNullSafe(F.col("__j.id"))
    out = keyed.join(judged, hit, "left_anti")
    repeated = judged.where("not __j.copy")
    if not repeated.isEmpty():  # repeated rows of a kept id and text: one of them
        out = out.unionByName(keyed.join(repeated, hit, "left_semi").dropDuplicates(["__node", id_col]))
    return restored(out, names)
