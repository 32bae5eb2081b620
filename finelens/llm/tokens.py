"""Token ids of Arrow text batches by the tokenizers library, once per distinct segment.

A text is cut where both kinds of vocabulary start afresh: before a single
blank between two solid characters (byte-level BPE) or at blanks (word BPE),
and where letters, digits and other signs meet (not behind an apostrophe, nor
next to a character whose class its bytes do not tell).  Segments are hashed for a whole slice at once; the library encodes each
distinct segment, and the ids of all texts are gathered from there.  A worker
keeps what it has encoded, up to ``CACHE`` segments unless told otherwise, for its next batches.

Segments are told apart by 64-bit hashes of their bytes and length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex

from finelens.llm import wordhash as W

#: Distinct segments a worker remembers before it starts anew.
CACHE = 400_000
#: Slices whose unknown segments are encoded together.
STRIDE = 8

#: UTF-8 of blanks beyond ASCII: next to them no cut is made.
_WIDE_BLANKS = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)
#: First bytes of these, looked for before the expression.
_WIDE_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: Beyond Latin letters, or with odd blanks, a segment goes to the library whole.
_ODD = re.compile("[\x1c-\x1f\x85\xa0ɐ-\U0010ffff]")

#: Greatest first byte of Latin letters that are not odd, and one.
_LATIN_END = 0xC9

_SOLID = ~W.BLANK.copy()
_SOLID[0x1C:0x20] = False

#: Byte classes: 0 blank or unknown, 1 letter, 2 digit, 3 other sign, 4 lead byte of U+00C0 to U+017F.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[0xC3:0xC6] = 4
_APOSTROPHE = 0x27


def mapped(text: bytes, table: np.ndarray) -> np.ndarray:
    """``table`` (256 bytes) of every byte."""
    return np.frombuffer(bytearray(text).translate(table.tobytes()), table.dtype)


def class_cuts(data: np.ndarray, text: bytes) -> np.ndarray:
    """Mask of the bytes at which a letter, digit or sign follows one of another class; ``text``: the same bytes."""
    kind = mapped(text, _CLASS)
    lead = np.flatnonzero(kind[:-1] == 4)
    second = data[lead + 1]
    # all but the signs of times and division, and the dotted I, whose lower case has a combining dot
    odd = ((data[lead] == 0xC3) & ((second == 0x97) | (second == 0xB7))) | ((data[lead] == 0xC4) & (second == 0xB0))
    kind[lead] = kind[lead + 1] = ~odd
    if len(kind) and kind[-1] == 4:
        kind[-1] = 0
    cut = np.zeros(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (data[:-1] != _APOSTROPHE)
    return cut


def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and the place of each hash among them."""
    ordered = np.sort(hashes)
    distinct = ordered[np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)]]
    # hashes are even: their leading bits tell about where they are
    bits = (4 * len(distinct)).bit_length()
    shift = np.uint64(64 - bits)
    first = np.zeros(1 << bits, np.int32)
    first[(distinct[::-1] >> shift).astype(np.intp)] = np.arange(len(distinct) - 1, -1, -1)
    place = first[(hashes >> shift).astype(np.intp)]
    late = np.flatnonzero(distinct[place] != hashes)
    while len(late):
        place[late] += 1
        late = late[distinct[place[late]] != hashes[late]]
    return distinct, place


def byte_table() -> dict[int, str]:
    """Byte to the printable character that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    table |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in table)}
    return table


def simple(text: str) -> bool:
    """An ASCII word, with or without a blank before it: one match of any split pattern."""
    return text.isascii() and (text.isalpha() or (text[0] == " " and text[1:].isalpha()))


class Encoder:
    """Ids of text columns for one vocabulary file of the tokenizers library.

    Special token strings inside a text are ordinary text.  Null is empty.
    """

    cache = CACHE

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.cache = cache
        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.normalizer = self.tokenizer.normalizer
        #: word BPE drops blanks; byte-level BPE keeps them
        self.by_word = spec["pre_tokenizer"]["type"] == "Sequence"
        if self.by_word:
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        else:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.split = regex.compile(pattern).findall
        self.table = byte_table()
        self.blank = self.table[0x20]
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes
        self.slot = np.zeros(0, np.int64)  # their places in first / count
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def ids_of(self, raw: bytes) -> Sequence[int]:
        """Ids of one segment."""
        if raw.isalpha():  # bytes: ASCII letters, as most segments are
            word = raw.decode("ascii")
            return [t.id for t in self.model.tokenize(word.lower() if self.by_word else word)]
        if not self.by_word and raw[0] == 0x20 and raw[1:].isalpha():
            return [t.id for t in self.model.tokenize(self.blank + raw[1:].decode("ascii"))]
        text = raw.decode("utf-8")
        if not self.by_word and max(raw) < _LATIN_END and text.removeprefix(" ").isalpha():
            return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.table))]
        if _ODD.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if self.by_word:
            text = text.lower() if text.isascii() else self.normalizer.normalize_str(text)
        # a word of letters, with or without a blank before it, is one match of the pattern
        parts = [text] if text.removeprefix(" ").isalpha() else self.split(text)
        out: list[int] = []
        for part in parts:
            shown = part.encode("utf-8").decode("latin-1").translate(self.table)
            out += [t.id for t in self.model.tokenize(shown)]
        return out

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every segment, and the rows' segment offsets."""
        if not len(data):
            return W.bounds(data, offsets)
        text = data.tobytes()
        own = class_cuts(data, text)
        if self.by_word:
            starts, ends, _ = W.bounds(data, offsets)
            own[starts] = True
            starts = np.flatnonzero(own)
            # a piece ends at the next cut or where its word ends
            word = np.searchsorted(ends, starts, "right")
            return starts, np.minimum(np.r_[starts[1:], len(data)], ends[word]), np.searchsorted(starts, offsets)
        solid = mapped(text, _SOLID)
        if any(lead[:1] in text and lead in text for lead in _WIDE_LEADS) and _WIDE_BLANKS.search(text):
            solid &= data < 0x80
        cut = (data == 0x20) | (data == 0x0A)
        cut[0] = cut[-1] = False
        cut[1:-1] &= solid[:-2] & solid[2:]
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        # a cut needs both neighbours in its own text
        inner = offsets[1:-1]
        cut[inner[inner < len(data)]] = False
        cut[inner[inner > 0] - 1] = False
        # a single line break is a match of its own
        cut[np.flatnonzero(cut & (data == 0x0A)) + 1] = True
        cut |= own
        cut[filled] = True
        starts = np.flatnonzero(cut)
        return starts, np.r_[starts[1:], len(data)], np.searchsorted(starts, offsets)

    def ids_of_all(self, raws: list[bytes]) -> list[Sequence[int]]:
        """Ids of many distinct segments."""
        return [self.ids_of(raw) for raw in raws]

    def learn(self, hashes: np.ndarray, raws: list[bytes]) -> None:
        """Encodes segments that are not known yet; ``hashes`` are distinct and sorted."""
        lists = self.ids_of_all(raws)
        counts = np.array([len(x) for x in lists], np.int64)
        slots = len(self.first) + np.arange(len(raws))
        self.first = np.r_[self.first, len(self.flat) + np.cumsum(counts) - counts]
        self.count = np.r_[self.count, counts]
        self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))]
        pos = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, pos, hashes)
        self.slot = np.insert(self.slot, pos, slots)

    def slots_of(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of sorted hashes, -1 where a segment is not known."""
        if not len(self.known):
            return np.full(len(hashes), -1, np.int64)
        near = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[near] == hashes, self.slot[near], -1)

    def encode(self, column: pa.Array):
        """Yields the int32 ids of every row, in order.

        A first pass over a stride of slices gathers its distinct segments, the
        unknown ones are encoded together, a second pass puts the ids in place.
        """
        data, offsets = W.text_bytes(column)
        slices = W.slices(data, offsets)
        while stride := list(islice(slices, STRIDE)):
            if len(self.known) > self.cache:
                self.reset()
            yield from self.encode_stride(stride)

    def encode_stride(self, stride: list):
        parts, fresh = [], {}
        for _, _, raw, offs in stride:
            starts, ends, at = self.segments(raw, offs)
            h = W.span_hashes(W.prefix(raw), starts, ends)
            distinct, back = places(h)
            slot = self.slots_of(distinct)
            new = np.flatnonzero(slot < 0)
            parts.append((slot, new, distinct[new], back, at))
            if not len(new):
                continue
            where = np.empty(len(distinct), np.int64)
            where[back] = np.arange(len(back))
            where = where[new]
            text = raw.tobytes()
            for x, a, b in zip(distinct[new].tolist(), starts[where].tolist(), ends[where].tolist()):
                if x not in fresh:
                    fresh[x] = text[a:b]
        if fresh:
            hashes = np.fromiter(fresh, np.uint64, len(fresh))
            order = np.argsort(hashes)
            raws = list(fresh.values())
            fresh.clear()
            self.learn(hashes[order], [raws[i] for i in order.tolist()])
        for slot, new, hashes, back, at in parts:
            slot[new] = self.slots_of(hashes)
            place = slot[back]
            n = self.count[place]
            upto = np.r_[0, np.cumsum(n)]
            flat = self.flat[np.arange(upto[-1]) + np.repeat(self.first[place] - upto[:-1], n)]
            cuts = upto[at].tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield flat[a:b]


@lru_cache(maxsize=4)
def encoder(path: str, cache: int = CACHE) -> Encoder:
    """One encoder a worker process, file and number of segments to remember."""
    return Encoder(path, cache)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
