"""Byte-level BPE: vectorised pre-tokenisation by transition-function scans, cached pair merging, decoding.

Every codepoint becomes one of ten symbols, an array operation with one codepoint of look-ahead. Each symbol is a
function from scanner states to scanner states; functions compose associatively, so blocks of symbols are reduced
side by side, block functions are combined by a prefix scan, and a second pass over all blocks at once reads off
where pieces start. No regular expression runs over the text.

Defined results: a null text is an empty text, which has no ids; any valid text decodes to its own UTF-8 bytes.
"""

from __future__ import annotations

import base64
import bisect
import functools
import heapq
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Symbols: letter, number, other, apostrophe before one or two letters of a contraction, space and other white space
#: (each: last of its run before a non-space, or not), start of a text.
LETTER, NUMBER, OTHER, APOS1, APOS2, SPACE_LAST, SPACE_MID, WHITE_LAST, WHITE_MID, BEGIN = range(10)
#: States: fresh (nothing to continue), in letters, in numbers, in others, after a space that joins what follows,
#: in white space, one or two letters of a contraction to come.
FRESH, LETTERS, NUMBERS, OTHERS, JOIN, WHITE, ONE, TWO = range(8)
#: Unicode White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions that are pieces of their own.
CONTRACTIONS = ["s", "t", "m", "d", "re", "ve", "ll"]
BLOCK = 256
#: Pieces that a worker remembers, and the length in bytes up to which it does and merges by a plain list.
PIECES_KEPT, SHORT = 150_000, 64
#: Slots, less one, of a hash table of pairs.
SLOTS = (1 << 20) - 1
#: Pieces merged at once: their matrices stay in a core's cache.
ROWS = 1024
#: A pair of ids is one integer, left * PAIR + right; the rank of pairs that never merge.
PAIR, NONE = 1 << 20, np.int32(1 << 30)


def _scanner() -> tuple[np.ndarray, np.ndarray]:
    """(state after, does a piece start), both [symbol, state]."""
    after, starts = np.zeros((10, 8), np.uint8), np.zeros((10, 8), bool)
    for state in range(8):
        for symbol in range(10):
            if symbol == BEGIN:
                to, new = FRESH, False
            elif symbol == LETTER and state in (ONE, TWO):
                to, new = (FRESH if state == ONE else ONE), False
            elif symbol in (LETTER, NUMBER, OTHER):
                to = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}[symbol]
                new = state not in (to, JOIN)
            elif symbol in (APOS1, APOS2):
                if state in (JOIN, OTHERS):
                    to, new = OTHERS, False
                else:
                    to, new = (ONE if symbol == APOS1 else TWO), True
            else:
                last = symbol in (SPACE_LAST, WHITE_LAST)
                to = JOIN if symbol == SPACE_LAST else WHITE
                new = last or state != WHITE
            after[symbol, state], starts[symbol, state] = to, new
    return after, starts


AFTER, STARTS = _scanner()
AFTER_BYTES, STARTS_BYTES = (x.astype(np.uint8).tobytes().ljust(256, b"\0") for x in (AFTER, STARTS))


def _looked_up(table: bytes, at: np.ndarray) -> np.ndarray:
    """table[at] for bytes; quicker than an index array."""
    return np.frombuffer(at.tobytes().translate(table), np.uint8).reshape(at.shape)


@functools.cache
def classes() -> np.ndarray:
    """Letter, number, other or white space of every codepoint."""
    major = np.frombuffer("".join(map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))).encode(), np.uint8)[::2]
    table = np.select([major == ord("L"), major == ord("N")], [LETTER, NUMBER], OTHER).astype(np.uint8)
    table[WHITE_SPACE] = WHITE_MID
    table[0x20] = SPACE_MID
    return table


def symbols(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each codepoint; ``first`` are the places of the marks that begin the texts."""
    out = classes()[codes]
    out[first] = BEGIN
    white = (out == SPACE_MID) | (out == WHITE_MID)
    follows = np.zeros(len(out), bool)
    follows[:-1] = ~white[1:] & (out[1:] != BEGIN)
    out[white & follows] -= 1
    at = np.flatnonzero(codes == ord("'"))
    padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
    one, two = padded[at + 1], padded[at + 2]
    for text in CONTRACTIONS:
        found = one == ord(text[0])
        if len(text) > 1:
            found &= two == ord(text[1])
        out[at[found]] = APOS1 if len(text) == 1 else APOS2
    return out


def piece_starts(sym: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each symbol, by composing the symbols' transition functions."""
    n = len(sym)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, BEGIN, np.uint8)
    padded[:n] = sym
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T) * np.uint8(8)
    reduced = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, 1)
    for column in columns:
        reduced = _looked_up(AFTER_BYTES, column + reduced)
    shift = 1
    while shift < blocks:  # prefix scan over blocks: (f then g)(state) = g[f[state]]
        later = np.take_along_axis(reduced[:, shift:], reduced[:, :-shift].astype(np.intp), 0)
        reduced = np.concatenate([reduced[:, :shift], later], 1)
        shift *= 2
    state = np.concatenate([np.zeros(1, np.uint8), reduced[FRESH, :-1]])
    out = np.empty((BLOCK, blocks), np.uint8)
    for i, column in enumerate(columns):
        at = column + state
        out[i] = at
        state = _looked_up(AFTER_BYTES, at)
    return _looked_up(STARTS_BYTES, out).T.reshape(-1)[:n].view(bool)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank merges first, the leftmost among equals."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    part: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    heap = [(rank, i, 2) for i in range(len(part) - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, width = heapq.heappop(heap)
        right = after[left] if part[left] is not None else len(part)
        if right >= len(part) or len(part[left]) + len(part[right]) != width:
            continue
        part[left] += part[right]
        part[right] = None
        after[left] = after[right]
        if after[left] < len(part):
            before[after[left]] = left
        for a, b in ((before[left], left), (left, after[left])):
            if a >= 0 and b < len(part) and (rank := ranks.get(both := part[a] + part[b])) is not None:
                heapq.heappush(heap, (rank, a, len(both)))
    return [ranks[x] for x in part if x is not None]


class Codec:
    """Encodes texts and decodes ids by a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = sorted((get(x[:i]) * PAIR + get(x[i:]), rank) for x, rank in self.ranks.items() for get in (self.ranks.get,) for i in range(1, len(x)) if x[:i] in self.ranks and x[i:] in self.ranks)
        self.pair_keys, self.pair_ranks = np.array([x for x, _ in pairs], np.int64), np.array([x for _, x in pairs], np.int32)
        with np.errstate(over="ignore"):
            self.pair_slots = self._slots(self.pair_keys)
        sizes = np.array([len(x) for x in self.bytes_of])
        self.blob, self.sizes, self.places = np.frombuffer(b"".join(self.bytes_of), np.uint8), sizes, np.cumsum(sizes) - sizes
        self.pieces: dict[bytes, bytes] = {}

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NONE where their bytes together are no entry."""
        keys = left.astype(np.int64) * PAIR + right
        out = np.full(len(keys) if keys.ndim == 1 else keys.shape, NONE, np.int32)
        for slots, factor in self.pair_slots:
            at = slots[(keys * factor >> 20) & SLOTS]
            np.copyto(out, self.pair_ranks[at], where=self.pair_keys[at] == keys)
        return out

    @staticmethod
    def _slots(keys: np.ndarray) -> list[tuple[np.ndarray, np.int64]]:
        """Hash tables that together hold the place of every key: what collides goes to the next table."""
        tables, left, factor = [], np.arange(len(keys)), np.int64(0x9E3779B97F4A7C1)
        while len(left):
            slots = np.zeros(SLOTS + 1, np.int32)
            at = (keys[left] * factor >> 20) & SLOTS
            slots[at] = left
            tables.append((slots, factor))
            left = left[slots[at] != left]
            factor = factor * np.int64(6364136223846793005) | np.int64(1)
        return tables

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many pieces of up to SHORT bytes: one merge in every row of a padded matrix at a time."""
        if not pieces:
            return []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max())
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        inside = np.arange(width + 1) < sizes[:, None]
        ids[inside] = self.byte_ids[flat]
        ranks = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        live, columns = np.arange(len(pieces)), np.arange(width + 1)
        out: list[bytes] = [b""] * len(pieces)
        while len(live):
            at = ranks.argmin(1)
            rows = np.arange(len(live))
            least = ranks[rows, at]
            done = least == NONE
            if done.any():
                rest = ids[done]
                used = rest >= 0
                flat, ends = rest[used].astype("<u4").tobytes(), (4 * np.cumsum(used.sum(1))).tolist()
                for place, begin, end in zip(live[done].tolist(), [0, *ends], ends, strict=False):
                    out[place] = flat[begin:end]
                keep = ~done
                live, ids, ranks, at, least = live[keep], ids[keep], ranks[keep], at[keep], least[keep]
                rows = np.arange(len(live))
                if not len(live):
                    break
            moved = np.minimum(columns + (columns > at[:, None]), width)
            ids = np.take_along_axis(ids, moved, 1)
            ids[:, -1] = -1
            ids[rows, at] = least
            ranks = np.take_along_axis(ranks, np.minimum(moved[:, :-1], width - 1), 1)
            ranks[:, -1] = NONE
            ranks[rows, at] = self._pair_ranks(ids[rows, at], ids[rows, np.minimum(at + 1, width)])
            before = at > 0
            ranks[rows[before], at[before] - 1] = self._pair_ranks(ids[rows[before], at[before] - 1], ids[rows[before], at[before]])
        return out

    def learn(self, pieces: set[bytes]) -> None:
        """Puts the ids of ``pieces`` into the cache, which is emptied first if it would outgrow its bound."""
        if len(self.pieces) > PIECES_KEPT:
            self.pieces.clear()
        missing = sorted(pieces - self.pieces.keys(), key=len)
        short = bisect.bisect_right(missing, SHORT, key=len)
        for i in range(0, short, ROWS):
            part = missing[i : min(short, i + ROWS)]
            self.pieces.update(zip(part, self.merge_all(part), strict=True))
        for piece in missing[short:]:
            self.pieces[piece] = np.array(merge(piece, self.ranks), "<u4").tobytes()

    def slices(self, texts: list[str]) -> Iterator[tuple[bytes, list[int]]]:
        """Each text's UTF-8 bytes with the byte offsets of its pieces, its length last."""
        marked = "\0" + "\0".join(texts)
        codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes + 1)[:-1]])
        places = np.flatnonzero(piece_starts(symbols(codes, first)))
        width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        offset = np.concatenate([np.zeros(1, np.int64), np.cumsum(width)])
        begin = offset[first] + 1
        bound = np.searchsorted(places, np.concatenate([first, [len(codes)]]))
        for i, text in enumerate(texts):
            data = text.encode("utf-8", "surrogatepass")
            yield data, [*(offset[places[bound[i] : bound[i + 1]]] - begin[i]).tolist(), len(data)]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(UTF-8 bytes, ids as little-endian unsigned 32-bit integers) of each text."""
        if not texts:
            return
        cut = [(data, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]) for data, cuts in self.slices(texts)]
        self.learn(set().union(*(x for _, x in cut)))
        of = self.pieces.__getitem__
        for data, pieces in cut:
            yield data, b"".join(map(of, pieces))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        at = np.frombuffer(ids, "<u4")
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.blob[np.repeat(self.places[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset of each id in the decoded bytes, their length last."""
        return np.concatenate([[0], np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])])


@functools.cache
def codec(path: str) -> Codec:
    """One codec for each rank file in each Python worker."""
    return Codec(path)


def portions(texts: list[str], most: int = 400_000) -> Iterator[list[str]]:
    """Runs of whole texts with about ``most`` characters at most, so that arrays stay small."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def by_slices(values: pa.Array, f: Callable[[list], pa.Array], rows: int = 256) -> pa.Array:
    """``f`` of the values, a few rows at a time as Python objects."""
    return pa.concat_arrays([f(values[i : i + rows].to_pylist()) for i in range(0, max(1, len(values)), rows)])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``: the ids of ``text`` as little-endian unsigned 32-bit integers, in one binary value a row."""

    @F.arrow_udf(T.BinaryType())
    def encoded(texts: pa.Array) -> pa.Array:
        found = codec(path)
        return by_slices(texts, lambda values: pa.array([x for part in portions([t or "" for t in values]) for _, x in found.encode(part)], pa.binary()))

    return df.withColumn(ids, encoded.asNondeterministic()(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Adds ``data``: the bytes that ``ids`` stand for."""

    @F.arrow_udf(T.BinaryType())
    def decoded(values: pa.Array) -> pa.Array:
        found = codec(path)
        return by_slices(values, lambda part: pa.array([found.decode(x or b"") for x in part], pa.binary()))

    return df.withColumn(data, decoded.asNondeterministic()(F.col(ids)))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    coded = decode(encode(docs.select("doc_id", "text"), path), path)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
