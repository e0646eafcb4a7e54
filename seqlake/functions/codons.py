"""Codon tables and translation as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import IUPAC, complement

# The public genetic codes. The standard code in the order T, C, A, G of each base; every other code by
# its differences from it, its start codons, and its stop codons where they are not those translated to '*'.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODES: dict[int, tuple[str, str, str, str]] = {
    1: ("The Standard Code", "", "TTG CTG ATG", ""),
    2: ("The Vertebrate Mitochondrial Code", "TGA:W ATA:M AGA:* AGG:*", "ATT ATC ATA ATG GTG", ""),
    3: ("The Yeast Mitochondrial Code", "TGA:W CTT:T CTC:T CTA:T CTG:T ATA:M", "ATA ATG", ""),
    4: ("The Mold, Protozoan, and Coelenterate Mitochondrial Code and the Mycoplasma/Spiroplasma Code", "TGA:W", "TTA TTG CTG ATT ATC ATA ATG GTG", ""),
    5: ("The Invertebrate Mitochondrial Code", "TGA:W ATA:M AGA:S AGG:S", "TTG ATT ATC ATA ATG GTG", ""),
    6: ("The Ciliate, Dasycladacean and Hexamita Nuclear Code", "TAA:Q TAG:Q", "ATG", ""),
    9: ("The Echinoderm and Flatworm Mitochondrial Code", "TGA:W AAA:N AGA:S AGG:S", "ATG GTG", ""),
    10: ("The Euplotid Nuclear Code", "TGA:C", "ATG", ""),
    11: ("The Bacterial, Archaeal and Plant Plastid Code", "", "TTG CTG ATT ATC ATA ATG GTG", ""),
    12: ("The Alternative Yeast Nuclear Code", "CTG:S", "CTG ATG", ""),
    13: ("The Ascidian Mitochondrial Code", "TGA:W ATA:M AGA:G AGG:G", "TTG ATA ATG GTG", ""),
    14: ("The Alternative Flatworm Mitochondrial Code", "TAA:Y TGA:W AAA:N AGA:S AGG:S", "ATG", ""),
    16: ("Chlorophycean Mitochondrial Code", "TAG:L", "ATG", ""),
    21: ("Trematode Mitochondrial Code", "TGA:W ATA:M AAA:N AGA:S AGG:S", "ATG GTG", ""),
    22: ("Scenedesmus obliquus Mitochondrial Code", "TCA:* TAG:L", "ATG", ""),
    23: ("Thraustochytrium Mitochondrial Code", "TTA:*", "ATT ATG GTG", ""),
    24: ("Pterobranchia Mitochondrial Code", "TGA:W AGA:S AGG:K", "TTG CTG ATG GTG", ""),
    25: ("Candidate Division SR1 and Gracilibacteria Code", "TGA:G", "TTG ATG GTG", ""),
    26: ("Pachysolen tannophilus Nuclear Code", "CTG:A", "CTG ATG", ""),
    27: ("Karyorelict Nuclear", "TAA:Q TAG:Q TGA:W", "ATG", "TGA"),
    28: ("Condylostoma Nuclear", "TAA:Q TAG:Q TGA:W", "ATG", "TAA TAG TGA"),
    29: ("Mesodinium Nuclear", "TAA:Y TAG:Y", "ATG", ""),
    30: ("Peritrich Nuclear", "TAA:E TAG:E", "ATG", ""),
    31: ("Blastocrithidia Nuclear", "TAA:E TAG:E TGA:W", "ATG", "TAA TAG"),
}
#: Letters in the order of a codon's digits: plain bases first, so that their codons are found early.
LETTERS = "ACGT-MRSVWYHKDBN"


@dataclass
class CodonTable:
    """Codons of A, C, G, T to amino acids; change it with set()."""

    id: int
    name: str
    amino: dict[str, str] = field(default_factory=dict)
    starts: set[str] = field(default_factory=set)
    stops: set[str] = field(default_factory=set)

    def set(self, codon: str, amino: str) -> CodonTable:
        if len(codon) != 3:
            raise ValueError(f"a codon has three letters: {codon!r}")
        self.amino[codon.upper().replace("U", "T")] = amino
        return self

    def clone(self) -> CodonTable:
        return CodonTable(self.id, self.name, dict(self.amino), set(self.starts), set(self.stops))

    def get(self, codon: str, allow_unknown: bool = False) -> str:
        """The amino acid; X where the codon's expansions disagree. A letter that is no base is an error, or X."""
        if len(codon) != 3:
            raise ValueError(f"a codon has three letters: {codon!r}")
        codes = [_code(c) for c in codon]
        if None in codes:
            if allow_unknown:
                return "X"
            raise ValueError(f"unknown codon: {codon!r}")
        return self.cells()[codes[0] * 256 + codes[1] * 16 + codes[2]]

    def cells(self) -> str:
        """Amino acids of all 16 * 16 * 16 codons of LETTERS, by their digits; '---' is a gap."""
        out = []
        for letters in product(LETTERS, repeat=3):
            if set(letters) == {"-"}:
                out.append("-")
                continue
            found = {self.amino.get("".join(c)) for c in product(*map(_bases, letters))}
            out.append(found.pop() if len(found) == 1 and None not in found else "X")
        return "".join(out)

    def __str__(self) -> str:
        rows = [f"{self.name} (transl_table={self.id})", "Initiation Codons: " + ", ".join(sorted(self.starts)), "Stop Codons: " + ", ".join(sorted(self.stops))]
        return "\n".join([*rows, *self.lines()])

    def lines(self, ambiguous: bool = False) -> list[str]:
        """A line for each amino acid with its codons; ambiguous: also the codons of degenerate letters that stand for it."""
        of = dict(self.amino)
        if ambiguous:
            cells = self.cells()
            of = {"".join(c): cells[i] for i, c in enumerate(product(LETTERS, repeat=3)) if cells[i] not in "X-"}
        return [f"{amino}: " + ", ".join(sorted(c for c, a in of.items() if a == amino)) for amino in sorted(set(of.values()))]


def _code(letter: str) -> int | None:
    letter = letter.upper().replace("U", "T")
    return LETTERS.index("-") if letter in " *-" else LETTERS.index(letter) if letter in LETTERS else None


def _bases(letter: str) -> str:
    code = IUPAC.index(letter)
    return "".join(b for bit, b in ((1, "A"), (2, "C"), (4, "G"), (8, "T")) if code & bit)


def codon_table(number: int = 1) -> CodonTable:
    if number not in CODES:
        raise ValueError(f"no codon table {number}")
    name, changes, starts, stops = CODES[number]
    amino = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), STANDARD, strict=True)} | dict(x.split(":") for x in changes.split())
    return CodonTable(number, name, amino, set(starts.split()), set(stops.split()) or {c for c, a in amino.items() if a == "*"})


def codon_rows() -> list[tuple[int, str, str, bool, bool]]:
    """(table, codon, amino acid, is start, is stop) of all tables, for a dimension table."""
    tables = [codon_table(i) for i in CODES]
    return [(t.id, c, a, c in t.starts, c in t.stops) for t in tables for c, a in t.amino.items()]


def translate(seq: Column, table: int | CodonTable = 1, frame: int = 1, trim: bool = False, clean: bool = False, allow_unknown: bool = True, mark_start: bool = False, rna: bool = False) -> Column:
    """The protein of a reading frame (1, 2, 3, or -1, -2, -3 on the reverse strand).

    trim: only what comes before the first X or stop. clean: stops become X. mark_start: the first codon of each open
    reading frame (the first one, and the one behind each stop) is M if it may start one. A sequence of fewer than three
    letters is an error; so is a letter that is no base, unless allow_unknown, where its codon is X. The reverse strand
    is complemented letter by letter, ambiguous and RNA bases too.
    """
    if frame not in (1, 2, 3, -1, -2, -3):
        raise ValueError(f"no frame {frame}")
    t = table if isinstance(table, CodonTable) else codon_table(table)
    strand = seq if frame > 0 else F.reverse(complement(seq, "RNAredundant" if rna else "DNAredundant"))
    cells, skipped = t.cells(), abs(frame) - 1
    starts = [("".join(c)) in t.starts for c in product(LETTERS, repeat=3)] if mark_start else None

    @F.pandas_udf("string")
    def proteins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(translated(list(batch), cells, starts, skipped, allow_unknown))

    out = proteins(strand)
    if trim:
        out = F.regexp_extract(out, "^([^X*]*)", 1)
    if clean:
        out = F.translate(out, "*", "X")
    return F.when(F.length(seq) < 3, F.raise_error(F.lit("sequence too short to translate")).cast("string")).otherwise(out)


_DIGIT = np.full(256, 16, np.int16)
for _i, _letter in enumerate(LETTERS):
    _DIGIT[[ord(_letter), ord(_letter.lower())]] = _i
_DIGIT[[ord("U"), ord("u")]] = LETTERS.index("T")
_DIGIT[[ord(" "), ord("*")]] = LETTERS.index("-")


def translated(seqs: list[str | None], cells: str, starts: list[bool] | None = None, skipped: int = 0, allow_unknown: bool = True) -> list[str | None]:
    """Proteins of many sequences at once: their codons behind so many letters are looked up in one pass over all bytes.

    cells, starts: amino acid of each codon of LETTERS by its digits, and whether it may start a frame.
    """
    size = np.array([len(x or "") for x in seqs], np.int64)
    begins = np.concatenate([[0], np.cumsum(size)])
    digit = _DIGIT[np.frombuffer("".join(x or "" for x in seqs).encode("latin-1", "replace"), np.uint8)]
    count = np.maximum(0, (size - skipped) // 3)
    first = np.concatenate([[0], np.cumsum(count)])
    of = np.repeat(np.arange(len(seqs)), count)
    place = begins[of] + skipped + 3 * (np.arange(first[-1]) - first[of])
    codon = np.stack([digit[place + k] for k in range(3)])
    known = (codon < 16).all(0)
    if not allow_unknown and not known.all():
        raise ValueError(f"unknown codon in {seqs[of[np.argmin(known)]]}")
    cell = np.where(known, codon[0].astype(np.int32) * 256 + codon[1] * 16 + codon[2], len(cells))
    aminos = np.frombuffer((cells + "X").encode("latin-1"), np.uint8)[cell]
    if starts is not None and len(aminos):
        # A frame is open at the front, and behind a stop if it was not open there: along a run of stops it changes each time.
        at = np.arange(len(aminos))
        last = np.concatenate([[-1], np.maximum.accumulate(np.where(aminos == ord("*"), -1, at))[:-1]])
        base = np.maximum(last, first[of] - 1)
        is_open = (base == first[of] - 1) ^ ((at - 1 - base) % 2 == 1)
        aminos = np.where(is_open & np.append(np.array(starts, bool), False)[cell], ord("M"), aminos).astype(np.uint8)
    text = aminos.tobytes().decode("latin-1")
    return [None if x is None else text[a:b] for x, a, b in zip(seqs, first, first[1:], strict=False)]
