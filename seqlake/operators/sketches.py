"""K-mer codes, ntHash, SimHash, minimizers, closed syncmers and protein k-mers.

Each sketch is a table function: rows in, (row, idx, code) out. Sequences are cut into pieces that overlap by as much as a
code looks ahead and back, so a sequence of any length takes the memory of a piece, and its pieces may go to many tasks;
each piece gives the codes of its own places only. The kernels work on many pieces at once in numpy: short reads are
laid end to end, and what reaches over an end is left out. 2-bit codes and ntHash also have a form in plain expressions.
Codes are unsigned 64-bit patterns in a BIGINT column; compare them as such with unsigned().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codons import codon_table, translated
from ..functions.sequence import IUPAC, let

# ntHash seeds of A, C, G, T (published); every other letter has the seed 0.
SEEDS = {"A": 0x3C8BFBB395C60474, "C": 0x3193C18562A02B4C, "G": 0x20323ED082572324, "T": 0x295549F54BE24456}
# 2-bit code of a letter is that of the first base it stands for; 4 is no base.
_CODE = np.full(256, 4, np.uint8)
for _i, _letter in enumerate(IUPAC):
    if _i:
        _CODE[[ord(_letter), ord(_letter.lower())]] = next(b for b in range(4) if _i >> b & 1)
_CODE[[ord("U"), ord("u")]] = 3
_SEED = np.zeros(256, np.uint64)
_PAIR_SEED = np.zeros(256, np.uint64)
for _b, _p in ("AT", "CG", "GC", "TA", "UA"):
    for _c in (_b, _b.lower()):
        _SEED[ord(_c)], _PAIR_SEED[ord(_c)] = SEEDS[_b.replace("U", "T")], SEEDS[_p]
#: K-mers whose bits are counted at a time, places of a piece, and letters that are worked on at a time.
BLOCK, PIECE, LETTERS = 1 << 14, 1 << 18, 1 << 18
Codes = tuple[np.ndarray, np.ndarray]


def unsigned(code: Column) -> Column:
    """A column that sorts and compares as the code's unsigned value."""
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    n %= 64
    return x if not n else (x << np.uint64(n)) | (x >> np.uint64(64 - n))


@dataclass
class Pieces:
    """Pieces laid end to end in an array of letters. at: where each begins there; size: its letters; low: the place in its
    sequence that its first letter has; begin, end: the places that are its own; places: how many the sequence has."""

    at: np.ndarray
    size: np.ndarray
    low: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    places: np.ndarray

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Piece and place in the array of all own places."""
        return _ranges(self.at + self.begin - self.low, self.end - self.begin)

    def idx(self, piece: np.ndarray, place: np.ndarray) -> np.ndarray:
        return place - self.at[piece] + self.low[piece]


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Shape:
    """What a sketch needs of a sequence.

    least, refused: the shortest sequence it takes, and what is said of shorter ones. less: places are letters less so many.
    wrap: letters of the front that follow a circular sequence's end. left, reach: places before the first own one, and letters
    from a place on, that a piece must hold. codes: (piece, idx, code) of letters and pieces. triples, skip, forward: letters are
    the amino acids of a nucleotide sequence's frame. legal: the letters that are allowed (none: all).
    """

    least: int
    refused: str
    less: int
    reach: int
    codes: Callable[[np.ndarray, Pieces], Found]
    wrap: int = 0
    left: int = 0
    triples: bool = False
    skip: int = 0
    forward: bool = True
    table: int = 1
    legal: str = ""

    def raw(self, low: int, high: int, n: int) -> tuple[int, int]:
        """The sequence's letters of which the letters from low to high are made; of n, or more if it is circular."""
        if not self.triples:
            return low, high
        low, high = self.skip + 3 * low, self.skip + 3 * high
        return (low, high) if self.forward else (n - high, n - low)

    def letters(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters of raw pieces laid end to end, and their numbers."""
        if not self.triples:
            return raw, size
        if not self.forward:
            first = np.concatenate([[0], np.cumsum(size)])
            piece, place = _ranges(first[:-1], size)
            raw = _PAIR[raw[first[piece + 1] - 1 - (place - first[piece])]]
        return np.frombuffer(translated([raw.tobytes().decode("latin-1")], _cells(self.table))[0].encode("latin-1"), np.uint8), size // 3


def _ranges(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and value of all members of ranges."""
    count = np.maximum(count, 0)
    which = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return which, begin[which] + np.arange(len(which)) - first[which]


def _hashes(letters: np.ndarray, k: int, canonical: bool = True) -> np.ndarray:
    n = max(0, len(letters) - k + 1)
    seed, pair = _SEED[letters], _PAIR_SEED[letters]
    forward = np.zeros(n, np.uint64)
    for j in range(k):
        forward ^= _rotated(seed[j : j + n], k - 1 - j)
    if not canonical:
        return forward
    reverse = np.zeros(n, np.uint64)
    for j in range(k):
        reverse ^= _rotated(pair[j : j + n], j)
    return np.minimum(forward, reverse)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost smallest value in every window of w, in time and memory that do not depend on w.

    The values are cut into blocks of w. A window is the end of one block and the front of the next one, so its smallest value
    is the smaller of two running minima: one that comes from its block's end, and one from the next block's front.
    """
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if w == 1:
        return np.arange(n)
    blocks = -(-len(h) // w)
    padded = np.full(blocks * w, np.iinfo(h.dtype).max, h.dtype)
    padded[: len(h)] = h
    rows, at = padded.reshape(blocks, w), np.arange(blocks * w).reshape(blocks, w)
    front = np.minimum.accumulate(rows, 1)
    # The place of a running minimum is where it last became less, or from behind, where it was last not exceeded.
    fell = np.concatenate([np.ones((blocks, 1), bool), front[:, 1:] < front[:, :-1]], 1)
    front_at = np.maximum.accumulate(np.where(fell, at, 0), 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1]
    held = np.concatenate([rows[:, :-1] <= back[:, 1:], np.ones((blocks, 1), bool)], 1)
    back_at = np.minimum.accumulate(np.where(held, at, blocks * w)[:, ::-1], 1)[:, ::-1].ravel()
    return np.where(back.ravel()[:n] <= front.ravel()[w - 1 : w - 1 + n], back_at[:n], front_at[w - 1 : w - 1 + n])


def _kmers(k: int, canonical: bool = True, circular: bool = False) -> Shape:
    if not 1 <= k <= 32:
        raise ValueError("k must be from 1 to 32")

    def codes(letters: np.ndarray, pieces: Pieces) -> Found:
        b = _CODE[letters]
        if (b > 3).any():
            raise ValueError("illegal base")
        b = b.astype(np.uint64)
        n = max(0, len(b) - k + 1)
        forward, reverse = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for j in range(k):
            forward = (forward << np.uint64(2)) | b[j : j + n]
            reverse |= (np.uint64(3) - b[j : j + n]) << np.uint64(2 * j)
        piece, place = pieces.own()
        idx = pieces.idx(piece, place)
        if canonical:
            return piece, idx, np.minimum(forward, reverse)[place]
        back = slice(None, None, -1)
        return np.concatenate([piece, piece[back]]), np.concatenate([idx, (pieces.places[piece] - 1 - idx)[back]]), np.concatenate([forward[place], reverse[place][back]])

    legal = "".join(chr(c) for c in range(128) if _CODE[c] < 4)
    return Shape(k, "sequence shorter than k", k - 1, k, codes, k - 1 if circular else 0, legal=legal)


def _nthash(k: int, canonical: bool = True, circular: bool = False) -> Shape:
    if k < 1:
        raise ValueError("k must be 1 or more")

    def codes(letters: np.ndarray, pieces: Pieces) -> Found:
        piece, place = pieces.own()
        return piece, pieces.idx(piece, place), _hashes(letters, k, canonical)[place]

    return Shape(k, "sequence shorter than k", k - 1, k, codes, k - 1 if circular else 0)


def _simhash(k: int, m: int, scale: int = 1, canonical: bool = True, circular: bool = False) -> Shape:
    if not 4 <= m <= k < 65535:
        raise ValueError("m must be from 4 to k, and k below 65535")
    if not 1 <= scale <= k - m + 1:
        raise ValueError("scale must be from 1 to k - m + 1")

    def codes(letters: np.ndarray, pieces: Pieces) -> Found:
        h = _hashes(letters, m, canonical)
        kept = h != 0
        if scale > 1:
            kept &= h <= np.uint64((1 << 64) // scale - (0 if (1 << 64) % scale else 1))
        h = np.where(kept, h, np.uint64(0))
        width, n = k - m + 1, max(0, len(letters) - k + 1)
        out = np.empty(n, np.uint64)
        for a in range(0, n, BLOCK):  # a row of 64 bits for each m-mer: some at a time
            b = min(n, a + BLOCK)
            part = h[a : b + width - 1]
            bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.zeros((len(part) + 1, 64), np.int32)
            np.cumsum(bits, axis=0, dtype=np.int32, out=ones[1:])
            total = np.concatenate([[0], np.cumsum(kept[a : b + width - 1])])
            count = (total[width:] - total[:-width])[:, None]
            most = (ones[width:] - ones[:-width] >= (count + 1) // 2) & (count > 0)
            out[a:b] = np.packbits(most, axis=1).view(">u8").ravel()
        piece, place = pieces.own()
        return piece, pieces.idx(piece, place), out[place]

    return Shape(k, "sequence shorter than k", k - 1, k, codes, k - 1 if circular else 0)


def _least_of(h: np.ndarray, w: int, pieces: Pieces) -> Found:
    """The smallest hash of each own window, where its place is another one than the window's before. A piece holds the window
    before its first own one, unless that is its sequence's first."""
    at = window_minima(h, w)
    piece, place = pieces.own()
    new = (place == pieces.at[piece]) | (at[place] != at[np.maximum(place - 1, 0)])
    piece, least = piece[new], at[place[new]]
    return piece, pieces.idx(piece, least), h[least]


def _minimizers(k: int, w: int, circular: bool = False) -> Shape:
    if k < 1:
        raise ValueError("k must be 1 or more")
    if not 1 <= w < 1 << 31:
        raise ValueError("w must be 1 or more")
    return Shape(k + w - 1, "sequence too short", k + w - 2, k + w - 1, lambda letters, pieces: _least_of(_hashes(letters, k), w, pieces), k - 1 if circular else 0, left=1)


def _syncmers(k: int, s: int, circular: bool = False) -> Shape:
    if not 1 <= s <= k:
        raise ValueError("s must be from 1 to k")
    half = k - s

    def codes(letters: np.ndarray, pieces: Pieces) -> Found:
        h, (piece, place) = _hashes(letters, k), pieces.own()
        if half:
            least = window_minima(_hashes(letters, s), 2 * half)
            _, begin = _ranges(pieces.at, pieces.size - s + 2 - 2 * half)
            at = least[begin]
            marked = np.zeros(len(letters) + 1, bool)
            marked[np.where(at < begin + half, at, at - half)] = True
            piece, place = piece[marked[place]], place[marked[place]]
        return piece, pieces.idx(piece, place), h[place]

    return Shape(2 * k - s - 1 if half else k, "sequence too short", k - 1, max(k, 2 * half - 1 + s), codes, k - 1 if circular else 0, left=max(0, half - 1))


@lru_cache
def _cells(table: int) -> str:
    return codon_table(table).cells()


_PAIR = np.arange(256, dtype=np.uint8)
for _b, _p in zip("ACGTURYSWKMBDHV", "TGCAAYRSWMKVHDB", strict=True):
    _PAIR[[ord(_b), ord(_b.lower())]] = ord(_p)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxhash64_windows(data: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """xxHash64 of every window of k bytes, all windows at once: step by step as the published algorithm reads one."""
    n = len(data) - k + 1
    seed_ = np.uint64(seed)

    def word(at: int, size: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out |= data[at + j : at + j + n].astype(np.uint64) << np.uint64(8 * j)
        return out

    lane = lambda acc, x: _rotated(acc + x * _P2, 31) * _P1
    at = 0
    with np.errstate(over="ignore"):
        if k >= 32:
            v = [np.full(n, x, np.uint64) for x in (seed_ + _P1 + _P2, seed_ + _P2, seed_, seed_ - _P1)]
            while at + 32 <= k:
                v = [lane(x, word(at + 8 * i, 8)) for i, x in enumerate(v)]
                at += 32
            h = _rotated(v[0], 1) + _rotated(v[1], 7) + _rotated(v[2], 12) + _rotated(v[3], 18)
            for x in v:
                h = (h ^ lane(np.zeros(n, np.uint64), x)) * _P1 + _P4
        else:
            h = np.full(n, seed_ + _P5, np.uint64)
        h = h + np.uint64(k)
        while at + 8 <= k:
            h = _rotated(h ^ lane(np.zeros(n, np.uint64), word(at, 8)), 27) * _P1 + _P4
            at += 8
        if at + 4 <= k:
            h = _rotated(h ^ (word(at, 4) * _P1), 23) * _P2 + _P3
            at += 4
        while at < k:
            h = _rotated(h ^ (word(at, 1) * _P5), 11) * _P1
            at += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def _protein_hashes(letters: np.ndarray, k: int) -> np.ndarray:
    return xxhash64_windows(letters, k) if len(letters) >= k else np.zeros(0, np.uint64)


def _framed(table: int, frame: int, is_protein: bool) -> dict[str, int | bool]:
    if frame not in (1, 2, 3, -1, -2, -3):
        raise ValueError(f"no frame {frame}")
    return {} if is_protein else {"triples": True, "skip": abs(frame) - 1, "forward": frame > 0, "table": table}


def _protein_kmers(k: int, table: int = 1, frame: int = 1, is_protein: bool = False) -> Shape:
    if k < 1:
        raise ValueError("k must be 1 or more")

    def codes(letters: np.ndarray, pieces: Pieces) -> Found:
        piece, place = pieces.own()
        return piece, pieces.idx(piece, place), _protein_hashes(letters, k)[place]

    return Shape(3 * k, "sequence shorter than 3 k", k - 1, k, codes, **_framed(table, frame, is_protein))


def _protein_minimizers(k: int, w: int, table: int = 1, frame: int = 1, is_protein: bool = False) -> Shape:
    if k < 1:
        raise ValueError("k must be 1 or more")
    if w < 1:
        raise ValueError("w must be 1 or more")
    return Shape(3 * k + w - 1, "sequence too short", k + w - 2, k + w - 1, lambda letters, pieces: _least_of(_protein_hashes(letters, k), w, pieces), left=1, **_framed(table, frame, is_protein))


SKETCHES: dict[str, Callable[..., Shape]] = {
    "kmers": _kmers, "nthash": _nthash, "simhash": _simhash, "minimizers": _minimizers, "syncmers": _syncmers, "protein_kmers": _protein_kmers, "protein_minimizers": _protein_minimizers,
}


def codes_of(seq: str, shape: Shape, size: int = PIECE) -> Codes:
    """idx and code of one sequence, in pieces of size places. A sequence that is too short or holds an illegal base is an error."""
    n = len(seq)
    if n < shape.least:
        raise ValueError(shape.refused)
    data = np.frombuffer(seq.encode("ascii", "replace"), np.uint8)
    total = (n - shape.skip) // 3 if shape.triples else n + shape.wrap
    places, out = total - shape.less, []
    for begin in range(0, places, size):
        end, low = min(begin + size, places), max(0, begin - shape.left)
        a, b = shape.raw(low, min(end - 1 + shape.reach, total), n)
        raw = np.concatenate([data[a:b], data[: b - n]]) if b > n else data[a:b]
        letters, sizes = shape.letters(raw, np.array([len(raw)]))
        out.append(shape.codes(letters, Pieces(np.zeros(1, np.int64), sizes, *(np.array([x]) for x in (low, begin, end, places))))[1:])
    idx, code = zip(*out, strict=True) if out else ([np.zeros(0, np.int64)], [np.zeros(0, np.uint64)])
    return np.concatenate(idx), np.concatenate(code)


def kmer_codes(seq: str, k: int, canonical: bool = True, circular: bool = False) -> Codes:
    """2-bit codes. canonical: the smaller of a k-mer's and its reverse complement's; else all k-mers of the forward
    strand, then all of the reverse one, each numbered from 0. Letters that are no base are an error."""
    return codes_of(seq, _kmers(k, canonical, circular), PIECE if canonical else max(1, len(seq)))


def nthash(seq: str, k: int, canonical: bool = True, circular: bool = False) -> Codes:
    """ntHash of every k-mer: the xor of rotated seeds; canonical: the smaller of both strands'."""
    return codes_of(seq, _nthash(k, canonical, circular))


def simhash(seq: str, k: int, m: int, scale: int = 1, canonical: bool = True, circular: bool = False) -> Codes:
    """SimHash of every k-mer over its m-mers' ntHashes, of which only the lowest 1/scale and none that is 0 count."""
    return codes_of(seq, _simhash(k, m, scale, canonical, circular))


def minimizers(seq: str, k: int, w: int, circular: bool = False) -> Codes:
    """The smallest canonical ntHash (leftmost first) of every window of w k-mers, given when its place changes."""
    return codes_of(seq, _minimizers(k, w, circular))


def syncmers(seq: str, k: int, s: int, circular: bool = False) -> Codes:
    """Closed syncmers: of every window of 2(k-s) s-mers, the k-mer that has the smallest s-mer at its start (if it lies in
    the first half) or at its end. Every k-mer is given once, with its canonical ntHash."""
    return codes_of(seq, _syncmers(k, s, circular))


def protein_kmers(seq: str, k: int, table: int = 1, frame: int = 1, is_protein: bool = False) -> Codes:
    """xxHash64 (seed 1) of every k-mer of the translation (or of a protein sequence itself); unknown codons are X."""
    return codes_of(seq, _protein_kmers(k, table, frame, is_protein))


def protein_minimizers(seq: str, k: int, w: int, table: int = 1, frame: int = 1, is_protein: bool = False) -> Codes:
    """Minimizers over protein k-mers."""
    return codes_of(seq, _protein_minimizers(k, w, table, frame, is_protein))


def pieces_of(df: DataFrame, shape: Shape, seq: str, skip_short: bool, size: int) -> DataFrame:
    """df without seq, a row for each piece of its sequences, and __piece: low, begin, end, places and the piece's letters."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != seq]
    text = F.col(f"`{seq}`")
    # One byte a letter; whatever else is no letter of any alphabet.
    text = F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(text, r"[^\x00-\x7F]", "?"))

    # What is left out is told inside the generator: filters would be pushed below the columns that the sequence is made of, and make it again.
    def cut(data: Column) -> Column:
        n = F.length(data).cast("long")
        total = F.floor((n - shape.skip) / 3) if shape.triples else n + shape.wrap
        places = total - shape.less

        def piece(begin: Column) -> Column:
            end, low = F.least(begin + size, places), F.greatest(begin - shape.left, F.lit(0))
            a, b = shape.raw(low, F.least(end - 1 + shape.reach, total), n)
            sub = lambda at, count: F.substr(data, (at + 1).cast("int"), count.cast("int"))
            raw = F.when(b > n, F.concat(sub(a, n - a), sub(F.lit(0), b - n))).otherwise(sub(a, b - a)) if shape.wrap else sub(a, b - a)
            return F.struct(low.alias("low"), begin.alias("begin"), end.alias("end"), places.alias("places"), raw.alias("raw"))

        made = F.when(places > 0, F.transform(F.sequence(F.lit(0).cast("long"), places - 1, F.lit(size).cast("long")), piece))
        if not skip_short:
            return F.when(n < shape.least, F.raise_error(F.lit(shape.refused))).otherwise(made)
        return F.when((n >= shape.least) & (F.translate(data.cast("string"), shape.legal, "") == "") if shape.legal else n >= shape.least, made)

    return df.select(*kept, text.alias("__seq")).select(*kept, F.explode(let(F.col("__seq").cast("binary"), cut)).alias("__piece"))


def sketch(df: DataFrame, kind: str, seq: str = "seq", skip_short: bool = True, size: int = PIECE, tasks: int = 0, **parameters: int | bool) -> DataFrame:
    """df's rows without the sequence, once for each code of it, with the columns idx (0-based) and code.

    Null sequences give no rows. A sequence that the sketch can't take (too short, an illegal base) gives none either, or
    is an error if skip_short is false. Sequences are worked on in pieces of size places; with tasks, pieces are dealt to so
    many tasks, so that a long sequence is not one task's work. Pieces are of the same bytes however they are dealt.
    """
    shape = SKETCHES[kind](**parameters)
    size = max(size, shape.reach + shape.left)  # a piece holds more of its own than of its neighbours
    pieces = pieces_of(df, shape, seq, skip_short, size)
    pieces = pieces.repartition(tasks) if tasks else pieces
    kept = pieces.schema.fields[:-1]
    names = [f"c{i}" for i in range(len(kept))]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, begin, end, places, raw = (batch.column(len(kept)).field(i) for i in range(5))
            sizes = np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1])
            upto, numbers = np.cumsum(sizes), [x.to_numpy() for x in (low, begin, end, places)]
            a = 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + LETTERS, "right")))
                joined = np.frombuffer(b"".join(raw.slice(a, b - a).to_pylist()), np.uint8)
                letters, count = shape.letters(joined, sizes[a:b].astype(np.int64))
                piece, idx, code = shape.codes(letters, Pieces(np.cumsum(count) - count, count, *(x[a:b] for x in numbers)))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a).take(pa.array(piece)) for c in batch.columns[: len(kept)]), pa.array(idx.astype(np.int32)), pa.array(code.view(np.int64))], names=[*names, "idx", "code"])
                a = b

    made = pieces.toDF(*names, "__piece").mapInArrow(codes, T.StructType([*[T.StructField(c, f.dataType, True) for c, f in zip(names, kept, strict=True)], T.StructField("idx", T.IntegerType()), T.StructField("code", T.LongType())]))
    return made.toDF(*[f.name for f in kept], "idx", "code")


def scaled_minhash(df: DataFrame, k: int, scale: int, seq: str = "seq") -> DataFrame:
    """The rows of nthash whose code is among the lowest 1/scale of all values."""
    limit = ((1 << 64) - 1) // scale
    return sketch(df, "nthash", seq, k=k).where(unsigned(F.col("code")) <= F.lit(limit - (1 << 63)))


def kmer_codes_native(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """kmers (canonical) of sequences of A, C, G, T and U as expressions only: df's columns, idx, code. k up to 31."""
    if not 1 <= k <= 31:
        raise ValueError("k must be from 1 to 31")
    # Pieces of 31 letters become one number for each strand; the codes of their k-mers are shifted out of it.
    step, n = 32 - k, F.length(seq)
    rows = df.where(n >= k).withColumn("__at", F.explode(F.sequence(F.lit(0), n - k, F.lit(step))))
    rows = rows.withColumn("__p", F.upper(F.substr(seq, F.col("__at") + 1, F.lit(31))))
    number = lambda digits: F.conv(digits, 4, 10).cast("long")
    rows = rows.withColumns({"__f": number(F.translate("__p", "ACGTU", "01233")), "__r": number(F.translate(F.reverse("__p"), "ACGTU", "32100")), "__n": F.length("__p") - k})
    rows = rows.drop("__p").withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    cut = lambda x, places: F.call_function("shiftright", x, 2 * places).bitwiseAND(F.lit((1 << 2 * k) - 1))
    code = F.least(cut(F.col("__f"), F.col("__n") - F.col("__j")), cut(F.col("__r"), F.col("__j")))
    return rows.withColumn("idx", F.col("__at") + F.col("__j")).withColumn("code", code).drop("__at", "__f", "__r", "__n", "__j")


def nthash_native(df: DataFrame, key: str, k: int, seq: str = "seq") -> DataFrame:
    """key, idx, code of nthash (canonical) as expressions only: the xor of the rotated seeds of each k-mer's letters, of either strand.
    Letters but A, C, G and T have no seed; k-mers without any are left out."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rol = lambda x, n: ((x << n % 64) | (x >> (64 - n % 64))) & ((1 << 64) - 1)
    pair = dict(zip("ACGT", "TGCA", strict=True))
    step = 512
    text = F.col(seq)
    # One byte a letter, so that a place is found without a scan; pieces, so that no row of a k-mer carries its sequence.
    rows = df.select(F.col(key), F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(text, r"[^\x00-\x7F]", "?")).cast("binary").alias("__b"))
    n = F.length("__b")
    cut = lambda at: F.struct(at.alias("at"), F.upper(F.substr(F.col("__b"), at + 1, F.lit(step + k - 1)).cast("string")).alias("raw"))
    rows = rows.select(key, F.explode(F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k, F.lit(step)), cut))).alias("__p"))
    rows = rows.select(key, "__p.at", "__p.raw").select(key, "at", "raw", F.explode(F.sequence(F.lit(0), F.length("raw") - k)).alias("__i"))
    rows = rows.select(key, (F.col("at") + F.col("__i")).alias("idx"), F.substr("raw", F.col("__i") + 1, F.lit(k)).alias("__k"))

    def strand(seed: Callable[[str, int], int]) -> Column:
        of = lambda j: reduce(lambda c, b: c.when(F.substring("__k", j + 1, 1) == b, F.lit(signed(seed(b, j)))), "CGT", F.when(F.substring("__k", j + 1, 1) == "A", F.lit(signed(seed("A", j))))).otherwise(F.lit(0).cast("long"))
        return reduce(lambda x, y: x.bitwiseXOR(y), (of(j) for j in range(k)))

    f, r = strand(lambda b, j: rol(SEEDS[b], k - 1 - j)), strand(lambda b, j: rol(SEEDS[pair[b]], j))
    strands = rows.where(F.rlike("__k", F.lit("[ACGT]"))).select(key, "idx", f.alias("f"), r.alias("r"))
    return strands.select(key, "idx", F.when(unsigned(F.col("f")) <= unsigned(F.col("r")), F.col("f")).otherwise(F.col("r")).alias("code"))
