"""Toxicity by multiple-instance learning: noisy-or over sentences.

Only documents are labelled; a document is toxic if one of its sentences is.
A sentence with marker words has probability sigmoid(bias + sum of its
markers' weights), any other 0; a document's score is
1 - (1 - leak) * prod(1 - p_sentence), the leak being the share of label 1 that
no sentence explains.  Markers are chosen and weights trained from document
labels alone, then every document is scored and its offending sentences are
located.

Words are runs of letters, digits and non-ASCII characters, lower-cased (A-Z);
sentences end at ``. ! ?`` and line ends.

Training takes at most ``TRAIN_TOXIC`` + ``TRAIN_CLEAN`` labelled documents, those
with the smallest hash of their id among rows whose crc32(doc_id) mod 3 is not 1;
the model (at most ``MARKERS`` hashes and weights) goes to the scoring tasks.

Defined results
---------------
* null, empty and marker-free texts get the leak as score;
* without labelled rows there are no markers and every score is 0;
* of several labels for one id the highest counts; repeated rows and null ids
  are scored row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finelens.llm import wordhash as W

#: Bounds of the training sample, documents of either label.
TRAIN_TOXIC, TRAIN_CLEAN = 5_000, 10_000
#: Words with the strongest association that become features, and the least documents they occur in.
MARKERS, MIN_DOCS = 512, 5
THRESHOLD = 0.7
#: Offending sentences have at least this probability.
SENTENCE = 0.5

STEPS, RATE, RIDGE = 400, 0.1, 1e-3

_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_END = np.zeros(256, bool)
_END[[0x0A, *b".!?"]] = True


@dataclass
class Model:
    markers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted word hashes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    leak: float = 0.0


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """Hashes and start bytes of all words, and the rows' word offsets."""
    low = W.LOWER[data]
    starts, ends, at = W.bounds(low, offsets, _NOT_WORD)
    return W.span_hashes(W.prefix(low), starts, ends), starts, at


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def choose_markers(hashes: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Sorted hashes of the words whose document frequency differs most by label.

    ``hashes`` and ``doc`` hold every distinct word of every document once.
    """
    order = np.argsort(hashes)
    ordered = hashes[order]
    edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    n = np.diff(np.r_[edge, len(ordered)])
    a = np.add.reduceat(toxic[doc[order]], edge)
    size, pos = len(toxic), toxic.sum()
    rate = n / size
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / max(pos, 1) + 1 / max(size - pos, 1)))
    z = (a / max(pos, 1) - (n - a) / max(size - pos, 1)) / spread
    z[n < MIN_DOCS] = 0
    best = np.argsort(-z, kind="stable")[:MARKERS]
    return np.sort(ordered[edge[best[z[best] > 3]]])


def train(column: pa.Array, toxic: np.ndarray) -> Model:
    """Fits markers, weights, bias and leak to texts with 0/1 labels by gradient ascent of the noisy-or likelihood.

    One pass over the texts counts words, a second finds the markers' places;
    only distinct words and marker hits are held.
    """
    toxic = np.asarray(toxic, float)
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(leak=float(toxic[0]) if len(toxic) else 0.0)
    data, offsets = W.text_bytes(column)
    words, owners = [], []
    for lo, _, raw, offs in W.slices(data, offsets):
        h, _, at = word_hashes(raw, offs)
        for k, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            words.append(np.unique(h[x:y]))
            owners.append(np.full(len(words[-1]), lo + k, np.int32))
    if not sum(map(len, words)):
        return Model(leak=float(toxic.mean()))
    markers = choose_markers(np.concatenate(words), np.concatenate(owners), toxic)
    del words, owners
    if not len(markers):
        return Model(leak=float(toxic.mean()))
    found = []
    base = 0
    for lo, _, raw, offs in W.slices(data, offsets):
        h, starts, at = word_hashes(raw, offs)
        pos = np.minimum(np.searchsorted(markers, h), len(markers) - 1)
        hit = np.flatnonzero(markers[pos] == h)
        # sentences by their number in the whole sample; the document keeps neighbours apart
        sent = np.cumsum(_END[raw])[starts[hit]] + base if len(raw) else hit
        found.append(np.stack([np.searchsorted(at, hit, "right") - 1 + lo, sent, pos[hit]], axis=1))
        base += len(raw)
    doc, sent, pos = np.concatenate(found).T
    # one row per (document, sentence), one entry per marker in it
    bags, row = np.unique(np.stack([doc, sent], axis=1), axis=0, return_inverse=True)
    entry = np.unique(np.stack([row.ravel(), pos], axis=1), axis=0)
    row, col, bag = entry[:, 0], entry[:, 1], bags[:, 0]
    x = np.zeros(len(markers) + 2)
    x[:-2], x[-2], x[-1] = 1.0, -1.0, -2.0  # weights, bias, logit of the leak
    m, v = np.zeros_like(x), np.zeros_like(x)
    n = len(toxic)
    for step in range(1, STEPS + 1):
        p = sigmoid(np.bincount(row, x[col], minlength=len(bag)) + x[-2])
        leak = float(sigmoid(x[-1]))
        clean = np.log(1 - leak) + np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)
        q = np.clip(-np.expm1(clean), 1e-9, 1)  # document probability
        # d likelihood / d log(1 - p): -1 for clean documents, (1 - q) / q for toxic ones
        g_doc = np.where(toxic > 0, (1 - q) / q, -1.0)
        g_sent = g_doc[bag] * p
        grad = np.r_[np.bincount(col, g_sent[row], minlength=len(markers)), g_sent.sum(), g_doc.sum() * leak] / n
        grad[:-2] -= RIDGE / n * x[:-2]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return Model(markers, x[:-2], float(x[-2]), float(sigmoid(x[-1])))


def scorer(model: Model):
    """mapInArrow function over (doc_id, text): score and offending sentences."""
    low16 = np.zeros(1 << 16, bool)
    low16[(model.markers & np.uint64(0xFFFF)).astype(np.int64)] = True

    def rows_of(raw: np.ndarray, offs: np.ndarray):
        n = len(offs) - 1
        score, found = np.full(n, model.leak), [[] for _ in range(n)]
        h, starts, at = word_hashes(raw, offs)
        maybe = np.flatnonzero(low16[(h & np.uint64(0xFFFF)).astype(np.int64)]) if len(h) and len(model.markers) else []
        if not len(maybe):
            return score, found
        pos = np.minimum(np.searchsorted(model.markers, h[maybe]), len(model.markers) - 1)
        hit = model.markers[pos] == h[maybe]
        word, pos = maybe[hit], pos[hit]
        if not len(word):
            return score, found
        doc = np.searchsorted(at, word, "right") - 1
        ends = np.flatnonzero(_END[raw])
        sent = np.searchsorted(ends, starts[word])  # sentence ends at ends[sent]
        bags, row = np.unique(np.stack([doc, sent], axis=1), axis=0, return_inverse=True)
        entry = np.unique(np.stack([row.ravel(), pos], axis=1), axis=0)
        p = sigmoid(np.bincount(entry[:, 0], model.weights[entry[:, 1]], minlength=len(bags)) + model.bias)
        clean = np.bincount(bags[:, 0], np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)
        score = 1 - (1 - model.leak) * np.exp(clean)
        chars = np.cumsum((raw & 0xC0) != 0x80)  # characters up to and with a byte
        upto = lambda b: int(chars[b - 1]) if b else 0
        for (d, s), prob in zip(bags.tolist(), p.tolist()):
            if prob >= SENTENCE:
                a = max(int(ends[s - 1]) + 1 if s else 0, int(offs[d]))
                b = min(int(ends[s]) + 1 if s < len(ends) else len(raw), int(offs[d + 1]))
                found[d].append({"start": upto(a) - upto(int(offs[d])), "length": upto(b) - upto(a), "score": prob})
        return score, found

    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            data, offsets = W.text_bytes(b.column(1))
            scores, found = [], []
            for _, _, raw, offs in W.slices(data, offsets):
                s, f = rows_of(raw, offs)
                scores.append(s)
                found += f
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.clip(flat, 0, 1)), pa.array(found, kind)], ["doc_id", "score", "sentences"]
            )

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on the bounded sample of labelled documents that are not held out."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.where(~held_out(F.col("doc_id")))
    key = F.xxhash64("doc_id")
    picked = [
        own.where(F.col("toxic") == y).orderBy(key, "doc_id").limit(n) for y, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))
    ]
    sample = picked[0].unionByName(picked[1])
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most TRAIN_TOXIC + TRAIN_CLEAN ids
    table = texts.dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").toArrow().sort_by("doc_id")
    return train(table["text"], table["toxic"].to_numpy())


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, offending sentences."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(rows, labels.select("doc_id", "toxic"))
    out = rows.mapInArrow(scorer(model), "doc_id long, score double, sentences array<struct<start:int,length:int,score:double>>")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        "sentences",
    )
