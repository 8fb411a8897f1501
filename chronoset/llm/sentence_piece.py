"""SentencePiece encoding and decoding of BPE models by suffix-array matching.

A batch's texts are cut where no piece can cross: before a blank that follows another character, and at each line
end. The distinct cuts are concatenated and indexed by a suffix array (places sorted by what follows, 16 bytes
deep). Each piece is looked up by binary search, which gives its range of occurrences; these are the edges, sorted by
the place where they end. Relaxation then goes through the places of all cuts side by side: of the edges that end at a
place, the longest whose piece may follow the best path to its start (the two pieces, encoded together, stay as
they are) extends it. For BPE that path is the encoding, so ids equal the library's. Characters that no piece
has fall back to bytes (or <unk> where the model has none).

The vocabulary's path is a parameter; the model is read once per worker process. Only identity normalisation, as in the
model used here, is supported: others are refused.

Defined results: null is taken as empty; empty texts have no ids; literal U+2581 equals a blank, as in the
library, so decoding gives the blank; unpaired surrogates are replaced by "?" (Spark strings have none). The added columns take the
place of columns of their names; all others stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Characters of text that are indexed together; a longer text is a batch of its own.
BATCH_CHARS = 2_000_000
#: Bytes of a batch below which an edge's end, place and slot fit into one 64-bit number.
PACKED = 1 << 23
_CUT = re.compile(" *[^ \n]+| +|\n")


#: Bytes of the character that a byte begins; 0 for bytes inside one.
_WIDTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16)


def _key(data: np.ndarray) -> np.ndarray:
    """The next 8 bytes at each place as one big-endian number; data must end with 8 or more zero bytes."""
    out = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[k : len(data) - 7 + k].astype(np.uint64)
    return out


class _Follows(dict):
    """(piece, piece) as first * size + second to whether both stay as they are when encoded together."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, pair: int) -> bool:
        if len(self) > 2_000_000:
            self.clear()
        self[pair] = ok = self.pieces.may_follow(*divmod(pair, self.pieces.size))
        return ok


@dataclass
class Pieces:
    """The normal pieces of a BPE model, by id."""

    text: list[str]  # blanks instead of U+2581; "" for other kinds of piece
    rank: list[float]  # of the merge that makes it, first merge first; -1 for single characters
    merge: dict[tuple[int, int], int]
    parts: list[tuple[int, int] | None]
    byte_ids: list[int]
    unknown: int

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.encode("ﬁ Ａ  a", out_type=str) != sp.encode("▁ﬁ Ａ  a".removeprefix("▁"), out_type=str) or "".join(sp.encode("a  b ", out_type=str)) != "▁a▁▁b▁":
            raise ValueError("only models with identity normalisation and a leading blank are supported")
        count = sp.get_piece_size()
        normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(count)]
        text = [sp.id_to_piece(i).replace("▁", " ") if normal[i] else "" for i in range(count)]
        if any(re.search("[^ ] |\n", t) for t in text):
            raise ValueError("a piece crosses a blank or line end, where texts are cut")
        rank = [-sp.get_score(i) if len(t) > 1 else -1.0 for i, t in enumerate(text)]
        by_text = {t: i for i, t in enumerate(text) if t}
        merge = {(by_text[t[:k]], by_text[t[k:]]): i for t, i in by_text.items() for k in range(1, len(t)) if t[:k] in by_text and t[k:] in by_text}
        bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        out = cls(text, rank, merge, [None] * count, bytes_ if all(sp.is_byte(i) for i in bytes_) else [], sp.unk_id())
        for i, t in enumerate(text):
            if len(t) > 1:
                out.parts[i] = out._last_merge(t, by_text, i)
        out._index()
        return out

    def _last_merge(self, t: str, by_text: dict[str, int], own: int) -> tuple[int, int] | None:
        """The two pieces that the piece's own encoding joins last; None if its encoding never reaches it."""
        found = [by_text.get(c, -1) for c in t]
        while len(found) > 1:
            best = min(((self.rank[m], k, m) for k, pair in enumerate(zip(found, found[1:], strict=False)) if (m := self.merge.get(pair)) is not None), default=None)
            if best is None:
                return None
            _, k, m = best
            if m == own:
                return found[0], found[1]
            found[k : k + 2] = [m]
        return None

    def _index(self) -> None:
        usable = [i for i, t in enumerate(self.text) if t and (len(t) == 1 or self.parts[i])]
        data = [self.text[i].encode() for i in usable]
        self.size = len(self.text) + 1  # and one id for characters that no piece has
        self.other = len(self.text)
        self.bytes_of = np.zeros(self.size, np.int64)
        self.bytes_of[usable] = [len(d) for d in data]
        self.ids = np.array(usable)
        # slots: pieces by falling length, and one for characters of each width that no piece has
        order = sorted(usable, key=lambda i: (-self.bytes_of[i], i))
        self.slot_id = np.array([*order, *[self.other] * 4])
        self.slot_len = np.array([*self.bytes_of[order], 4, 3, 2, 1])
        self.slot_of = np.zeros(self.size, np.int64)
        self.slot_of[order] = np.arange(len(order))
        self.other_slot = len(order) + np.array([3, 3, 2, 1, 0])
        if len(self.slot_id) >= 1 << 16:
            raise ValueError("the model has too many pieces")
        self.keys = []  # per level of 8 bytes: smallest and largest key with that beginning
        for at in (0, 8):
            part = [d[at : at + 8] for d in data]
            self.keys.append(tuple(np.array([int.from_bytes(p.ljust(8, f), "big") for p in part], np.uint64) for f in (b"\0", b"\xff")))
        self.tails = {k: d[16:] for k, d in enumerate(data) if len(d) > 16}
        self.long = np.array([len(d) > 8 for d in data])
        self.follows = _Follows(self)

    def may_follow(self, a: int, b: int) -> bool:
        """Undo the later merge of the two again and again; the seam holds if no merge across it would have come first."""
        if self.other in (a, b):
            return True
        rank, limit_a, limit_b = self.rank, float("inf"), float("inf")
        # limit_a: a merge across the seam counts only if it comes before the merge that consumed the left piece;
        # limit_b: the same for the right piece. Of equal merges the left one comes first.
        while True:
            m = self.merge.get((a, b))
            if m is not None and rank[m] < limit_a and rank[m] <= limit_b:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit_a = rank[a]
                a = self.parts[a][1]
            else:
                limit_b = rank[b]
                b = self.parts[b][0]


def edges_of(pieces: Pieces, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, piece) of every occurrence of every piece. Zero bytes end the cuts; no piece has one."""
    first = _key(np.r_[data, np.zeros(24, np.uint8)])
    second = first[8 : len(data) + 8]
    first = first[: len(data)]
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    a = first[starts]
    order = np.argsort(a, kind="stable")
    a = a[order]
    low, high = np.searchsorted(a, pieces.keys[0][0], "left"), np.searchsorted(a, pieces.keys[0][1], "right")
    same = np.flatnonzero(a[1:] == a[:-1])
    if len(same) and pieces.long.any():
        # deeper only where a long piece's first 8 bytes occur
        wide = pieces.long & (high > low)
        b = second[starts[order]]
        for lo, hi in sorted(set(zip(low[wide].tolist(), high[wide].tolist(), strict=True))):
            inner = np.argsort(b[lo:hi], kind="stable")
            order[lo:hi] = order[lo:hi][inner]
            b[lo:hi] = b[lo:hi][inner]
    else:
        b = second[starts[order]]
    for k in np.flatnonzero(pieces.long & (high > low)):
        lo, hi = low[k], high[k]
        low[k] = lo + np.searchsorted(b[lo:hi], pieces.keys[1][0][k], "left")
        high[k] = lo + np.searchsorted(b[lo:hi], pieces.keys[1][1][k], "right")
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    place = starts[order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]]
    if pieces.tails:
        keep = np.ones(len(which), bool)
        bounds = np.r_[0, np.cumsum(count)]
        for k, tail in pieces.tails.items():
            for j in range(bounds[k], bounds[k + 1]):
                at = place[j] + 16
                keep[j] = data[at : at + len(tail)].tobytes() == tail
        which, place = which[keep], place[keep]
    return place, pieces.ids[which]


def encode_cuts(pieces: Pieces, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all cuts one after another, number of ids of each)."""
    if not cuts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = [c.encode("utf-8", "replace") for c in cuts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    begin = np.r_[0, np.cumsum(lengths + 1)[:-1]].astype(np.int64)
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    start, piece = edges_of(pieces, data)
    # a character that no piece has gets an edge of its own; the zero bytes that end cuts get none
    width = _WIDTH[data]
    bare = width > 0
    bare[begin + lengths] = False
    bare[start[pieces.bytes_of[piece] == width[start]]] = False
    alone = np.flatnonzero(bare)
    start = np.r_[start, alone]
    slot = np.r_[pieces.slot_of[piece], pieces.other_slot[width[alone]]]
    # sort edges by the place where they end within their cut, then by the place itself, the longest first
    end = start + pieces.slot_len[slot]
    owner_begin = np.repeat(begin, lengths + 1)
    rel_end = end - owner_begin[start]
    if len(data) < PACKED:
        packed = np.sort((rel_end << 40) | (end << 16) | slot)
        slot, end, rel_end = packed & 0xFFFF, (packed >> 16) & 0xFFFFFF, packed >> 40
    else:
        order = np.lexsort((slot, end, rel_end))
        slot, end, rel_end = slot[order], end[order], rel_end[order]
    start, piece = end - pieces.slot_len[slot], pieces.slot_id[slot]
    at_begin, strange = start == owner_begin[start], piece == pieces.other
    last = np.full(len(data) + 1, -1, np.int32)  # the slot that ends the best path to a place
    bounds = np.flatnonzero(np.r_[True, rel_end[1:] != rel_end[:-1], True]).tolist() if len(rel_end) else [0]
    follows, size, slot_id = pieces.follows, pieces.size, pieces.slot_id
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        before = last[start[lo:hi]]
        reached = before >= 0
        previous = slot_id[before]
        ok = at_begin[lo:hi] | (reached & (strange[lo:hi] | (previous == pieces.other)))
        left = np.flatnonzero(reached & ~ok)
        if len(left):
            ok[left] = [follows[k] for k in (previous[left] * size + piece[lo + left]).tolist()]
        good = np.flatnonzero(ok) + lo
        last[end[good[::-1]]] = slot[good[::-1]]  # of several, the longest is written last
    # walk back from all ends side by side
    place, live = begin + lengths, np.flatnonzero(lengths > 0)
    out_slot, out_start = [], []
    while len(live):
        at = place[live]
        found = last[at]
        if (found < 0).any():
            raise ValueError("a place has no path; the model's pieces can't be reached by merges")
        place[live] = at = at - pieces.slot_len[found]
        out_slot.append(found)
        out_start.append(at)
        live = live[at > begin[live]]
    if not out_slot:
        return np.empty(0, np.int64), np.zeros(len(cuts), np.int64)
    at_place = np.full(len(data), -1, np.int32)
    at_place[np.concatenate(out_start)] = np.concatenate(out_slot)
    start = np.flatnonzero(at_place >= 0)
    slot = at_place[start]
    piece, owner = slot_id[slot], np.repeat(np.arange(len(cuts)), lengths + 1)[start]
    strange = piece == pieces.other
    if strange.any():
        wide = np.where(strange, pieces.slot_len[slot], 1) if pieces.byte_ids else np.ones(len(piece), np.int64)
        offset = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        owner, piece, start, strange = (np.repeat(x, wide) for x in (owner, piece, start, strange))
        piece[strange] = np.array(pieces.byte_ids)[data[start[strange] + offset[strange]]] if pieces.byte_ids else pieces.unknown
    return piece, np.bincount(owner, minlength=len(cuts))


class _Places(dict):
    def __missing__(self, cut: str) -> int:
        self[cut] = k = len(self)
        return k


def encode(pieces: Pieces, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text, as the library gives them without begin or end."""
    seen, owner = _Places(), []
    for text in texts:
        found = _CUT.findall(" " + text.replace("▁", " ")) if text else []
        owner.append(np.fromiter(map(seen.__getitem__, found), np.int64, len(found)))
    ids, counts = encode_cuts(pieces, list(seen))
    begin = np.cumsum(counts) - counts
    out = []
    for own in owner:
        n = counts[own]
        total = int(n.sum())
        out.append(ids[np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(total)] if total else np.empty(0, np.int64))
    return out


@lru_cache(2)
def loaded(model: str) -> tuple[Pieces, Decoder]:
    """One a process: the merges of all pieces take as long as many texts."""
    pieces = Pieces.load(model)
    return pieces, Decoder(pieces)


class Decoder:
    """Ids to text: pieces one after another, runs of byte pieces as UTF-8, without the leading blank."""

    def __init__(self, pieces: Pieces):
        self.bytes_of = [t.encode() for t in pieces.text]
        for b, i in enumerate(pieces.byte_ids):
            self.bytes_of[i] = bytes([b])

    def __call__(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


def tokenize(docs: DataFrame, model: str = MODEL, text: str = "text", with_ids: bool = True) -> DataFrame:
    """docs with `_ids` (array<int>, if asked for), `_n_tokens`, `_ids_sha256` (of the ids as little-endian int32), `_decoded_sha256` and `_round_trip`.

    One pass without a shuffle; the batch of texts that is indexed at once is bounded.
    """
    extra = [StructField("_ids", ArrayType(IntegerType()))] * with_ids + [StructField("_n_tokens", LongType()), StructField("_ids_sha256", StringType()), StructField("_decoded_sha256", StringType()), StructField("_round_trip", BooleanType())]
    docs = docs.drop(*(f.name for f in extra if f.name != text))
    schema = StructType([*docs.schema.fields, *extra])
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, decode = loaded(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(column).to_pylist()]
            at = 0
            while at < len(texts):
                end, held = at + 1, len(texts[at])
                while end < len(texts) and held + len(texts[end]) <= BATCH_CHARS:
                    held += len(texts[end])
                    end += 1
                ids = encode(pieces, texts[at:end])
                packed = [x.astype("<i4") for x in ids]
                decoded = [decode(x) for x in ids]
                rows = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in packed]), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]), pa.array([d == t.replace("▁", " ") for d, t in zip(decoded, texts[at:end], strict=True)])]
                if with_ids:
                    flat = np.concatenate(packed) if packed else np.empty(0, "<i4")
                    offsets = np.r_[0, np.cumsum([len(x) for x in packed])].astype(np.int32)
                    rows.insert(0, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns, *rows], [f.name for f in schema.fields])
                at = end

    return docs.mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False).select(
        "doc_id", F.col("_n_tokens").alias("n_tokens"), F.col("_ids_sha256").alias("ids_sha256"), F.col("_decoded_sha256").alias("decoded_sha256"), F.col("_round_trip").alias("round_trip")
    )
