"""Ranked lexical search by the Best Position Algorithm over impact lists.

A query's terms are looked up in impact lists: the documents that hold a term,
greatest impact first.  Documents are dealt into blocks of bounded size, every
block has its own lists, and a block is searched for all queries:

1. each list is read from its best position on (the end of its contiguous seen
   prefix), a chunk at a time;
2. a document met for the first time is looked up directly in all other lists;
   its places there count as seen, so best positions often run ahead of what
   was read;
3. no unmet document can score more than the sum of the lists' impacts at
   their best positions; the search of the block stops when that sum is
   strictly below the kth best score (equal scores still matter: the smaller
   id wins), or when all lists are at their ends.

A task carries its k best of each query from block to block, so that later
blocks stop early, and hands out k rows a query; the k best of these are the
result.  Nothing of a document but its matched terms and its number of terms
is stored, and no list of a whole corpus exists in one place.

Statistics (documents with a term N, terms L, documents of a term) are counted
over all documents first.  Queries are taken in slices of at most
``SLICE_CHARS`` characters, each against all documents: a slice's terms are
what goes to the tasks.  Terms are told apart by 64-bit hashes and lengths.

Defined results
---------------
* null or empty texts and texts without terms match nothing, and are not in N;
* rows without doc_id are ranked as documents of their own, behind equal scores;
  repeated rows are ranked as often as they occur;
* rows of one item_id are one query, repeated texts of it count once; a null
  item_id is an id like any other; a query without matches has no rows;
* weights are doubles, everything else 64-bit integers; a very long text is one
  posting row, its terms counted slice by slice;
* empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from finelens.llm import wordhash as W
from finelens.llm.common import stored

K = 20
#: Characters of query texts taken against all documents at a time.
SLICE_CHARS = 1 << 24
#: Documents and postings of a block.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 14, 1 << 21
#: Positions read from each list in the first round; doubled each round.
CHUNK = 64
#: Bytes of dense place tables kept for a block; terms beyond are looked up by bisection.
PLACES = 1 << 26

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes that part terms: ASCII but letters and digits.
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

POSTING_SCHEMA = "id long, n long, terms array<int>, tfs array<int>"


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.translate(_LOWER))


@dataclass
class Queries:
    """A slice of queries: item ids, their (term number, repeats), and the terms' hashes in order."""

    items: list
    parts: list[list[tuple[int, int]]]
    hashes: np.ndarray
    lengths: np.ndarray


def slice_of(rows: list[tuple]) -> Queries:
    texts: dict = {}
    for item, text in rows:
        texts.setdefault(item, Counter()).update(terms_of(text or ""))
    words = sorted({t for c in texts.values() for t in c})
    raw = [w.encode("utf-8") for w in words]
    lengths = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(lengths)
    joined = np.frombuffer(b"".join(raw), np.uint8)
    hashes = W.span_hashes(W.prefix(joined), ends - lengths, ends) if raw else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    number = {words[i]: k for k, i in enumerate(order.tolist())}
    parts = [sorted((number[t], c) for t, c in counted.items()) for counted in texts.values()]
    return Queries(list(texts), parts, hashes[order], lengths[order])


def query_slices(items: DataFrame, item_col: str, text_col: str) -> Iterator[Queries]:
    """Queries in slices; all rows of an item are in one."""
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct().orderBy("item", "text")
    held: list[tuple] = []
    chars = 0
    for r in rows.toLocalIterator():
        if chars >= SLICE_CHARS and r["item"] != held[-1][0]:
            yield slice_of(held)
            held, chars = [], 0
        held.append((r["item"], r["text"]))
        chars += len(r["text"] or "")
    if held:
        yield slice_of(held)


def _match(batches: Iterator[pa.RecordBatch], hashes: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Posting rows: id, number of terms, the query terms held and how often."""
    for batch in batches:
        data, offsets = W.text_bytes(batch.column(1))
        for lo, hi, raw, offs in W.slices(data, offsets):
            low = W.LOWER[raw]
            starts, ends, at = W.bounds(low, offs, _GAP)
            h = W.span_hashes(W.prefix(low), starts, ends)
            place = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
            hit = np.zeros(len(h), bool)
            if len(hashes):
                hit = (hashes[place] == h) & (lengths[place] == ends - starts)
            row = np.repeat(np.arange(hi - lo), np.diff(at))[hit]
            key, tf = np.unique(row * max(1, len(hashes)) + place[hit], return_counts=True)
            row, term = key // max(1, len(hashes)), key % max(1, len(hashes))
            cuts = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(np.diff(at), pa.int64()),
                    pa.ListArray.from_arrays(cuts, pa.array(term, pa.int32())),
                    pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int32())),
                ],
                names=["id", "n", "terms", "tfs"],
            )


class Block:
    """Impact lists of some documents: per term its documents by falling impact."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int):
        """``n_docs``, ``n_terms``: of the whole corpus."""
        if len(n) and 25 * int(n.max()) * n_docs >= 1 << 63:
            m = np.array([75 + 25 * x * n_docs // n_terms for x in n.tolist()], np.int64)
        else:
            m = 75 + 25 * n * n_docs // n_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        order = np.lexsort((doc, -impact, term))
        self.size = len(n)
        self.doc, self.impact = doc[order], impact[order]
        terms, first = np.unique(term[order], return_index=True)
        self.span = {t: (a, b) for t, a, b in zip(terms.tolist(), first.tolist(), [*first[1:].tolist(), len(order)])}
        self.places: dict[int, np.ndarray | tuple] = {}
        self.room = PLACES

    def place(self, term: int, docs: np.ndarray) -> np.ndarray:
        """Direct access: the documents' places in a term's list, -1 where they are not in it."""
        table = self.places.get(term)
        if table is None:
            a, b = self.span[term]
            if self.room >= 4 * self.size:
                self.room -= 4 * self.size
                table = np.full(self.size, -1, np.int32)
                table[self.doc[a:b]] = np.arange(b - a)
            else:
                table = (by := np.argsort(self.doc[a:b]), self.doc[a:b][by])
            self.places[term] = table
        if isinstance(table, np.ndarray):
            return table[docs]
        by, docs_there = table
        at = np.minimum(np.searchsorted(docs_there, docs), len(by) - 1)
        return np.where(docs_there[at] == docs, by[at], -1)


class Best:
    """The k best (score, id) of a query so far; ids without a value are last among equals."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a document must at least score to enter; 1 while there are fewer than k."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        good = score >= self.least()
        if not good.any():
            return
        score, ids, none = (np.r_[a, b[good]] for a, b in ((self.score, score), (self.id, ids), (self.none, none)))
        order = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.id, self.none = score[order], ids[order], none[order]


def search_block(block: Block, query: list[tuple[int, int]], ids: np.ndarray, none: np.ndarray, best: Best) -> int:
    """Adds a block's documents to ``best``; ``query`` has (term, weight times repeats). Returns the places read."""
    lists = [(t, w, *block.span[t]) for t, w in query if w and t in block.span]
    seen = [np.zeros(b - a, bool) for _, _, a, b in lists]
    upto = [0] * len(lists)  # best positions: so many places from the top are seen
    met = np.zeros(block.size, bool)
    chunk, read = CHUNK, 0
    while any(p < len(s) for p, s in zip(upto, seen)):
        fresh = []
        for (_, _, a, _), p, s in zip(lists, upto, seen):
            new = np.flatnonzero(~s[p : p + chunk]) + p
            s[new] = True
            read += len(new)
            fresh.append(block.doc[a + new])
        docs = np.unique(np.concatenate(fresh))
        docs = docs[~met[docs]]
        met[docs] = True
        score = np.zeros(len(docs), np.int64)
        for (t, w, a, _), s in zip(lists, seen):
            place = block.place(t, docs)
            there = np.flatnonzero(place >= 0)
            s[place[there]] = True
            score[there] += w * block.impact[a + place[there]]
        best.add(score, ids[docs], none[docs])
        bound = 0
        for j, ((_, w, a, _), s) in enumerate(zip(lists, seen)):
            gap = np.flatnonzero(~s[upto[j] :])[:1]
            upto[j] = upto[j] + int(gap[0]) if len(gap) else len(s)
            if len(gap):
                bound += w * int(block.impact[a + upto[j] - 1])
        if bound < best.least():
            break
        chunk *= 2
    return read


def _search(
    batches: Iterator[pa.RecordBatch],
    items: pa.Array,
    queries: list[list[tuple[int, int]]],
    n_docs: int,
    n_terms: int,
    k: int,
) -> Iterator[pa.RecordBatch]:
    best = [Best(k) for _ in queries]
    held: list[pa.RecordBatch] = []

    def run() -> None:
        whole = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        ids = whole.column("id").combine_chunks()
        none = np.asarray(ids.is_null())
        ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        lists = whole.column("terms").combine_chunks()
        doc = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        term = np.asarray(lists.flatten()).astype(np.int64)
        tf = np.asarray(whole.column("tfs").combine_chunks().flatten()).astype(np.int64)
        block = Block(np.asarray(whole.column("n")).astype(np.int64), doc, term, tf, n_docs, n_terms)
        for query, own in zip(queries, best):
            search_block(block, query, ids, none, own)

    docs = postings = 0
    for batch in batches:
        step = 1 << 12
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            docs, postings = docs + part.num_rows, postings + len(part.column(2).flatten())
            held.append(part)
            if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                run()
                docs = postings = 0
    if held:
        run()
    rows = [(q, i, x, s) for q, b in enumerate(best) for i, x, s in zip(b.id.tolist(), b.none.tolist(), b.score.tolist())]
    if rows:
        yield pa.RecordBatch.from_arrays(
            [
                items.take(pa.array([r[0] for r in rows])),
                pa.array([None if r[2] else r[1] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
            ],
            names=["item_id", "id", "score"],
        )


def postings_of(docs: DataFrame, queries: Queries, id_col: str, text_col: str) -> DataFrame:
    """Stored posting rows of all documents for the terms of a slice."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stored(
        rows.mapInArrow(partial(_match, hashes=queries.hashes, lengths=queries.lengths), POSTING_SCHEMA), "postings"
    )


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search_slice(docs: DataFrame, queries: Queries, item_type: T.DataType, id_col: str, text_col: str, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of a slice of queries against all documents."""
    postings = postings_of(docs, queries, id_col, text_col)
    n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weights = {t: weight(n_docs, c) for t, c in df.items()}
    weighted = [[(t, c * weights[t]) for t, c in parts if t in weights] for parts in queries.parts]
    search = partial(
        _search,
        items=pa.array(queries.items, to_arrow_type(item_type)),
        queries=weighted,
        n_docs=n_docs,
        n_terms=n_terms,
        k=k,
    )
    schema = f"item_id {item_type.simpleString()}, id long, score long"
    found = postings.where("n > 0").mapInArrow(search, schema)
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def best_documents(
    items: DataFrame,
    docs: DataFrame,
    item_col: str = "item_id",
    item_text_col: str = "text",
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = K,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for every item."""
    kind = items.schema[item_col].dataType
    parts = [
        search_slice(docs, queries, kind, id_col, text_col, k) for queries in query_slices(items, item_col, item_text_col)
    ]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)
