"""Operator 7: SentencePiece encoding and decoding with a merge-type prefix table.

For a text of n characters the table keeps, for every prefix, the last token of that prefix's encoding. There is
exactly one such token: among the vocabulary's matches that end at the place (found by an automaton, longest
first), the one that is compatible with the last token of the prefix before it. The ids are then read backwards.
Work is linear in the text but for the few matches at each place.

Merges never cross the front of a space run or a character outside the vocabulary, so a text is cut there and equal
segments share one table look-up while a task runs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table, with_columns

SPACE = "▁"
#: Segments and pairs of tokens that a process remembers before it starts again, and the longest segment that it remembers:
#: about 80 MB together.
REMEMBERED, PAIRS, LONGEST = 120_000, 400_000, 64


class PieceTable:
    """Encoder and decoder for a SentencePiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = model.unk_id()
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        order = sorted((i for i in normal if len(self.pieces[i]) > 1), key=lambda i: (-model.get_score(i), i))
        #: When a merge makes the piece; characters are there from the start.
        self.rank = {i: -1 for i in normal} | {i: r for r, i in enumerate(order)}
        self.halves: dict[int, tuple[int, int]] = {}
        self._pairs: dict[int, bool] = {}
        self._lengths = [len(p) for p in self.pieces]
        self._characters = {p for p in self.ids if len(p) == 1}
        self._matcher = ahocorasick.Automaton()
        for i in sorted(normal, key=lambda i: len(self.pieces[i])):
            if len(self.pieces[i]) == 1 or self._split(i):
                self._matcher.add_word(self.pieces[i], i)
        self._matcher.make_automaton()
        self._segments: dict[str, tuple[str, int, str]] = {}
        self._cut = re.compile(self._borders())

    def _borders(self) -> str:
        """A pattern of segments that no merge leaves: cut before a space run, at \\n if it is no piece, and after
        a letter that only letters follow inside pieces, where another kind of character comes."""
        inner = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        letters = {c for c in self._characters if c.isalpha()}
        while left := {a for a, b in inner if a in letters and b not in letters}:
            letters -= left
        kept = "".join(map(re.escape, sorted(letters))) or "\\x00"
        line = "" if "\n" in self.ids else "\\n"
        other = f"[^{kept}{SPACE}{line}]"
        return f"{SPACE}+{other}*[{kept}]*|{other}+[{kept}]*|[{kept}]+" + (f"|{line}" if line else "")

    def _split(self, i: int) -> bool:
        """Find the last merge in the piece's own encoding; False where merges never make the piece."""
        piece = self.pieces[i]
        for k in range(1, len(piece)):
            left, right = self.ids.get(piece[:k]), self.ids.get(piece[k:])
            if left is None or right is None or any(x not in self.halves and len(self.pieces[x]) > 1 for x in (left, right)):
                continue
            if self._holds(left, right, self.rank[i]):
                self.halves[i] = (left, right)
                return True
        return False

    def _holds(self, left: int, right: int, until: float) -> bool:
        """True if no merge joins the two tokens before the merge of rank until.

        Merges at the seam are undone latest first. While the seam lies between two inner tokens, a piece that
        spans it and ranks before the undone merge would have been made first; at equal rank the leftmost is.
        """
        limit = until
        while True:
            joined = self.ids.get(self.pieces[left] + self.pieces[right])
            if joined is not None and self.rank[joined] < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.halves[left][1]
            else:
                limit, right = b + 1, self.halves[right][0]

    def compatible(self, left: int, right: int) -> bool:
        """True if the two tokens stay apart when their texts are encoded as one."""
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        known = self._pairs[left << 20 | right] = self._holds(left, right, float("inf"))
        return known

    def forget(self) -> None:
        """Drop what earlier texts have left."""
        self._segments.clear()
        self._pairs.clear()

    def _known(self, run: str) -> list[int]:
        """Ids of a run of characters that are all in the vocabulary."""
        last = [-1] * len(run)
        lengths, pairs = self._lengths, self._pairs
        for end, token in self._matcher.iter(run):
            if last[end] < 0:  # matches at one place come longest first
                before = end - lengths[token]
                if before < 0:
                    last[end] = token
                else:
                    fits = pairs.get(last[before] << 20 | token)
                    if fits or fits is None and self.compatible(last[before], token):
                        last[end] = token
        ids, place = [], len(run) - 1
        while place >= 0:
            ids.append(last[place])
            place -= lengths[last[place]]
        return ids[::-1]

    def _segment(self, segment: str) -> tuple[str, int, str]:
        if self._characters.issuperset(segment):
            ids = self._known(segment)
            return ",".join(map(str, ids)), len(ids), segment.replace(SPACE, " ")
        ids, run = [], ""
        for c in segment:
            if c in self.ids:
                run += c
                continue
            ids += self._known(run) if run else []
            run = ""
            ids += [self.bytes[b] for b in c.encode("utf-8", "replace")] if self.bytes else [self.unknown]
        ids += self._known(run) if run else []
        return ",".join(map(str, ids)), len(ids), self._text(ids)

    def _text(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.pieces[i].replace(SPACE, " "))
        return "".join([*out, held.decode("utf-8", "replace")])

    def coded(self, text: str) -> tuple[str, int, str]:
        """Ids joined by commas, their number, and the decoded text."""
        if not text:
            return "", 0, ""
        known = self._segments
        parts = []
        for segment in self._cut.findall(SPACE + text.replace(" ", SPACE)):
            part = known.get(segment)
            if part is None:
                part = self._segment(segment)
                if len(segment) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[segment] = part
            parts.append(part)
        return ",".join([p[0] for p in parts]), sum([p[1] for p in parts]), "".join([p[2] for p in parts])[1:]

    def encode(self, text: str) -> list[int]:
        ids = self.coded(text)[0]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; the space that encoding puts in front goes."""
        text = self._text(ids)
        return text[1:] if ids and self.pieces[ids[0]].startswith(SPACE) else text


@lru_cache(maxsize=2)
def piece_table(model_file: str) -> PieceTable:
    return PieceTable(model_file)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_texts(docs: DataFrame, text: str = "text", model_file: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Add n_tokens, ids_sha256, decoded_sha256 and, if keep_ids, ids (array) to every row.

    Null texts count as empty: no ids, the hash of the empty text. Texts of any length are encoded whole; repeated rows are
    encoded each, and an empty table stays empty. Columns of docs stay; those of the names above are replaced.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def coder() -> Callable[[list[str]], list[pa.Array]]:
        tokens = piece_table(model_file or default_model())
        tokens.forget()

        def coded(texts: list[str]) -> list[pa.Array]:
            done = [tokens.coded(t) for t in texts]
            sha = lambda x: hashlib.sha256(x.encode("utf-8", "replace")).hexdigest()
            out = [pa.array([n for _, n, _ in done], pa.int64()), pa.array([sha(ids) for ids, _, _ in done], pa.string()), pa.array([sha(t) for _, _, t in done], pa.string())]
            if keep_ids:
                flat = np.fromstring(",".join([ids for ids, _, _ in done if ids]), np.int32, sep=",") if any(n for _, n, _ in done) else np.zeros(0, np.int32)
                ends = np.concatenate([[0], np.cumsum([n for _, n, _ in done])]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            return out

        return coded

    return with_columns(docs, text, fields, coder)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
