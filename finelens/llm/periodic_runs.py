"""Periodic runs of words, by longest common extensions from suffix trees.

A run is a maximal stretch of words with smallest period ``q`` that is at
least ``max(min_words, min_exponent * q)`` words long.  Every run has a Lyndon
root: one of its words starts a stretch of ``q`` words that is the longest
Lyndon word there, in the words' order or in its reverse.  So, for a sequence:

1. Ukkonen's algorithm builds the suffix tree of the sequence and that of its
   reversal; an Euler tour of a tree gives the order of the suffixes and the
   depth of the lowest common ancestor between neighbouring leaves, and a
   sparse table over these depths answers any common extension in constant
   time;
2. the longest Lyndon word at ``i`` ends where the next smaller suffix (in the
   reverse order: the next greater one) begins;
3. each of these 2n candidates is extended to the right by the tree of the
   sequence and to the left by that of the reversal; stretches that are long
   enough are the runs, each found once or more.

Only stretches of a document that can hold a run get trees.  In a run of L
words at least ``min_words - min_words // min_exponent`` words from any start
on recur within L / min_exponent words; so positions that no such recurring
window covers are cut away, again and again while stretches get shorter.  The
test compares hashes, and a collision can only keep more.

Work is per document; the largest task is the longest text.  A tree holds some
300 bytes a word in a worker while a stretch of that text is searched.

Defined results
---------------
* null, empty and blank texts have no words, no runs and an empty collapsed text;
* words are exact bytes between blanks, case and punctuation included;
* a word is dropped if any run holds it behind the run's first period;
* runs are sorted by start, then period; two runs may overlap or share a start;
* repeated rows and null ids are searched row by row; an empty table gives an
  empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finelens.llm.common import let, words_of

MIN_WORDS = 24
MIN_EXPONENT = 3

RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
OUT_SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of symbols from 1 on, behind it the terminal 0."""

    def __init__(self, symbols: Sequence[int]):
        self.text = [*symbols, 0]
        self.width = max(self.text) + 1
        self.build()
        self.tour()

    def build(self) -> None:
        text, width = self.text, self.width
        open_end = len(text)
        first, last, link = [0], [0], [0]  # by node: its edge's label, the suffix link; the root is 0
        edges: dict[int, int] = {}  # node * width + symbol -> child
        node = length = pending = edge = 0
        for i, symbol in enumerate(text):
            pending += 1
            waiting = 0  # the inner node that still lacks its link
            while pending:
                if not length:
                    edge = i
                key = node * width + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(first)
                    first.append(i)
                    last.append(open_end)
                    link.append(0)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    begin = first[child]
                    span = (last[child] if last[child] <= i else i + 1) - begin
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    if text[begin + length] == symbol:
                        if waiting:
                            link[waiting] = node
                        length += 1
                        break
                    inner = len(first)
                    first += (begin, i)
                    last += (begin + length, open_end)
                    link += (0, 0)
                    first[child] = begin + length
                    edges[key] = inner
                    edges[inner * width + text[begin + length]] = child
                    edges[inner * width + symbol] = inner + 1
                    if waiting:
                        link[waiting] = inner
                    waiting = inner
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        self.first, self.last, self.edges = first, last, edges

    def tour(self) -> None:
        """Ranks of the suffixes, and a sparse table over the ancestors' depths between neighbouring leaves."""
        n = len(self.text)
        keys = np.fromiter(self.edges, np.int64, len(self.edges))
        kids = np.fromiter(self.edges.values(), np.int64, len(self.edges))
        order = np.argsort(keys)
        parent = keys[order] // self.width
        # children by parent, the largest symbol first: the stack hands out the smallest
        kids = kids[order][::-1].tolist()
        bounds = np.searchsorted(parent, np.arange(len(self.first) + 1))
        lo, hi = (len(kids) - bounds[1:]).tolist(), (len(kids) - bounds[:-1]).tolist()
        label = (np.array(self.last) - np.array(self.first)).tolist()
        self.edges = {}
        order_of, depths = [], []
        stack, low = [(0, 0)], n
        while stack:
            node, depth = stack.pop()
            if depth < low:
                low = depth
            a, b = lo[node], hi[node]
            if a == b:
                order_of.append(n - depth - label[node])
                depths.append(low)
                low = n
            else:
                depth += label[node]
                stack += [(kid, depth) for kid in kids[a:b]]
        self.rank = np.empty(n, np.int64)
        self.rank[order_of] = np.arange(n)
        level = np.array(depths, np.int32)  # level[r]: common prefix of the suffixes ranked r - 1 and r
        self.table, step = [level], 1
        while 2 * step <= n:
            level = np.minimum(level[:-step], level[step:])
            self.table.append(level)
            step *= 2

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``i`` and ``j`` (i < j <= length)."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            t = self.table[k]
            out[at] = np.minimum(t[a[at]], t[b[at] - (1 << k)])
        return out


def lyndon_ends(rank: list[int]) -> tuple[list[int], list[int]]:
    """Where the longest Lyndon word at each place ends, in the order of suffixes and in its reverse.

    In the reverse the terminal is the greatest symbol: what would end there is no word of the text.
    """
    n = len(rank) - 1  # the last suffix is the terminal alone
    ends = []
    for sign in (1, -1):
        end, open_ = [n] * n, []
        for i in range(n):
            r = sign * rank[i]
            while open_ and open_[-1][0] > r:
                end[open_.pop()[1]] = i
            open_.append((r, i))
        ends.append(end)
    return ends[0], ends[1]


def stretch_runs(symbols: list[int], min_words: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of symbols from 1 on."""
    n = len(symbols)
    tree, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    found = set()
    for forward, ends in zip((True, False), lyndon_ends(tree.rank.tolist())):
        i, e = np.arange(n), np.array(ends)
        near = ((e - i) * min_exponent <= n) & ((e < n) | forward)
        i, e = i[near], e[near]
        p = e - i
        right = tree.extension(i, e)
        left = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        left[inner] = back.extension(n - e[inner], n - i[inner])
        length = left + p + right
        good = (length >= min_words) & (length >= min_exponent * p)
        found.update(zip((i - left)[good].tolist(), length[good].tolist(), p[good].tolist()))
    return list(found)


def stretches(symbols: np.ndarray, min_words: int, min_exponent: int) -> list[tuple[int, int]]:
    """The stretches that can hold a run: covered by windows that recur close by."""
    n, window = len(symbols), min_words - min_words // min_exponent
    if n < min_words:
        return []
    keys = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + symbols[k : n - window + 1 + k].astype(np.uint64)
    sorted_keys = np.sort(keys)
    if not (sorted_keys[1:] == sorted_keys[:-1]).any():
        return []
    out, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a < min_words:
            continue
        own = keys[a : b - window + 1]
        order = np.argsort(own, kind="stable")
        by = own[order]
        close = np.flatnonzero((by[1:] == by[:-1]) & (np.diff(order) * min_exponent <= b - a))
        starts = np.concatenate([order[close], order[close + 1]])
        edge = np.bincount(starts, minlength=b - a + 1) - np.bincount(starts + window, minlength=b - a + 1)
        covered = np.concatenate([[False], np.cumsum(edge)[: b - a] > 0, [False]])
        turns = (np.flatnonzero(covered[1:] != covered[:-1]) + a).tolist()
        parts = list(zip(turns[::2], turns[1::2]))
        if parts == [(a, b)]:
            out.append((a, b))
        else:
            todo += parts
    return out


def runs_of(words: Sequence[bytes], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a word sequence, by start, then period."""
    number: dict[bytes, int] = {}
    symbols = np.array([number.setdefault(w, len(number) + 1) for w in words], np.int64)
    out = []
    for a, b in stretches(symbols, min_words, min_exponent):
        _, dense = np.unique(symbols[a:b], return_inverse=True)
        out += [(a + s, length, p) for s, length, p in stretch_runs((dense + 1).tolist(), min_words, min_exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
    return b" ".join([words[i] for i in keep])


def _search(batches: Iterator[pa.RecordBatch], min_words: int, min_exponent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs, texts = [], []
        for text in batch.column(1).cast(pa.binary()):
            words = (text.as_py() or b"").split()
            own = runs_of(words, min_words, min_exponent)
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
            texts.append(collapsed(words, own))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(runs, pa.list_(RUN_TYPE)), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "runs", "collapsed"],
        )


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """One row per document: doc_id, its runs and its text without their repetitions."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_search, min_words=min_words, min_exponent=min_exponent), OUT_SCHEMA)


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, the first of equals; null without runs."""
    return F.reduce(
        runs,
        F.get(runs, F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )


def with_planted_period(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): about a tenth of the texts, picked by a checksum of the id, become periodic from some word on.

    With h = crc32 of the decimal id and g = h div 10, a text of n words is changed
    if h % 10 = 0: from word a = g % n on it repeats its next 1 + (n - a) div (3 + g % 8) words.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i.cast("long")).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(words, lambda _, i: F.get(words, place(i).cast("int"))), " ")

    text = F.coalesce(F.col(text_col), F.lit(""))
    planted = let(words_of(text), lambda w: F.when(F.size(w) == 0, F.lit("")).otherwise(repeated(w)))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.when(h % 10 == 0, planted).otherwise(text).alias("text")
    )


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests, from the rows of ``periodic_runs``."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    listed = F.array_join(F.transform("runs", line), "")
    rows = found.select("doc_id", "runs", "collapsed", strongest(F.col("runs")).alias("best"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
