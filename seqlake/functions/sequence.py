"""Column functions over sequences: alphabets, ranges, complements, composition, windows, degenerate letters.

All are compositions of built-in expressions. Sequences are strings; a null sequence gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, their pairs, gaps and ambiguous letters of the alphabets, in the order in which they are guessed.
ALPHABETS: dict[str, tuple[str, str, str, str]] = {
    "DNA": ("acgtACGT", "tgcaTGCA", " -.", "nN."),
    "RNA": ("acguACGU", "ugcaUGCA", " -.", "nN"),
    "DNAredundant": ("acgtryswkmbdhvACGTRYSWKMBDHV", "tgcayrswmkvhdbTGCAYRSWMKVHDB", " -.", "nN."),
    "RNAredundant": ("acguryswkmbdhvACGURYSWKMBDHV", "ugcayrswmkvhdbUGCAYRSWMKVHDB", " -.", "nN"),
    "Protein": ("abcdefghijklmnopqrstuvwyzABCDEFGHIJKLMNOPQRSTUVWYZ", "abcdefghijklmnopqrstuvwyzABCDEFGHIJKLMNOPQRSTUVWYZ", " -", "xX*_."),
}
UNLIMITED = "Unlimit"
GAPS = " -."
# IUPAC letters and the bases that they stand for, by the sum of the bases' bits (A 1, C 2, G 4, T or U 8).
IUPAC = "-ACMGRSVTWYHKDBN"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; inside a higher-order function an expression is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _class(chars: str) -> str:
    return "[" + "".join(f"\\{c}" if c in r"\-[]^*." else c for c in dict.fromkeys(chars)) + "]"


def all_letters(alphabet: str) -> str:
    letters, _, gaps, ambiguous = ALPHABETS[alphabet]
    return letters + gaps + ambiguous


def alphabet_rows() -> list[tuple[str, str, str, str]]:
    """(alphabet, letter, pair, kind) of every letter; gaps and ambiguous letters pair with themselves."""
    return [(name, a, b, "letter") for name, (letters, pairs, _, _) in ALPHABETS.items() for a, b in zip(letters, pairs, strict=True)] + [(name, c, c, kind) for name, (_, _, gaps, amb) in ALPHABETS.items() for kind, chars in (("gap", gaps), ("ambiguous", amb)) for c in chars]


# ranges


def sub_location(length: Column, start: Column | int, end: Column | int) -> Column:
    """struct(start, end, ok): a 1-based closed range resolved against a length; negative places count from the end.

    0 is the first (start) or last place (end). A start before the first place is moved to it, an end behind the last
    to that. ok is false for an empty sequence, a start behind the end of the sequence, two negative places in the
    wrong order, and a range that is empty by more than one place.
    """
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    s0 = F.when(start == 0, 1).otherwise(start)
    e0 = F.when(end == 0, -1).otherwise(end)
    s = F.when(s0 < -length, 1).when(s0 < 0, length + s0 + 1).otherwise(s0)
    e = F.when(e0 > length, length).when(e0 < 0, length + e0 + 1).otherwise(e0)
    ok = (length > 0) & ~((s0 < 0) & (e0 < 0) & (s0 > e0)) & (s0 <= length) & (s - 1 <= e)
    return F.struct(F.when(ok, s).otherwise(0).cast("int").alias("start"), F.when(ok, e).otherwise(0).cast("int").alias("end"), ok.alias("ok"))


def sub_seq(seq: Column, start: Column | int, end: Column | int) -> Column:
    """The range's letters; an empty text where the range is not ok."""
    at = sub_location(F.length(seq), start, end)
    return F.when(at["ok"], F.substr(seq, at["start"], at["end"] - at["start"] + 1)).when(seq.isNotNull(), F.lit(""))


# gaps, validity, alphabets


def remove_gaps(seq: Column, letters: str = GAPS) -> Column:
    return F.translate(seq, letters, "") if letters else seq


def remove_gaps_with_quality(seq: Column, qual: Column, letters: str = GAPS) -> Column:
    """struct(seq, qual) without the places of seq that hold a gap letter."""
    kept = F.filter(F.arrays_zip(F.split(seq, "").alias("s"), F.split(qual, "").alias("q")), lambda p: ~p["s"].isin(*letters)) if letters else F.arrays_zip(F.split(seq, "").alias("s"), F.split(qual, "").alias("q"))
    return F.struct(F.array_join(F.transform(kept, lambda p: p["s"]), "").alias("seq"), F.array_join(F.transform(kept, lambda p: p["q"]), "").alias("qual"))


def bases(seq: Column, gaps: str = GAPS) -> Column:
    """Letters that are no gap."""
    return F.length(remove_gaps(seq, gaps))


def is_valid(seq: Column, alphabet: str) -> Column:
    if alphabet == UNLIMITED:
        return seq.isNotNull()
    return F.rlike(seq, F.lit(f"^{_class(all_letters(alphabet))}*$")) & ~F.endswith(seq, F.lit("\n"))


def first_invalid(seq: Column, alphabet: str) -> Column:
    """The first letter outside the alphabet; null if there is none."""
    if alphabet == UNLIMITED:
        return F.lit(None).cast("string")
    found = F.regexp_extract(seq, f"([^{_class(all_letters(alphabet))[1:-1]}])", 1)
    return F.when(found != "", found)


def guess_alphabet(seq: Column, first: int = 10_000) -> Column:
    """Name of the first alphabet that holds the first letters (0: all) of the sequence; empty: Unlimit."""
    head = F.substring(seq, 1, first) if first else seq
    out = F.when(seq.isNull(), F.lit(None)).when(head == "", UNLIMITED)
    for name in ALPHABETS:
        out = out.when(is_valid(head, name), name)
    return out.otherwise(UNLIMITED)


def guess_alphabet_broadly(seq: Column, first: int = 10_000) -> Column:
    """As guess_alphabet, with DNA and RNA widened by their redundant letters."""
    name = guess_alphabet(seq, first)
    return F.when(name.isin("DNA", "RNA"), F.concat(name, F.lit("redundant"))).otherwise(name)


# complements


def complement(seq: Column, alphabet: str = "DNA") -> Column:
    """Every letter's pair; letters without one stay."""
    if alphabet in (UNLIMITED, "Protein"):
        return seq
    letters, pairs, _, _ = ALPHABETS[alphabet]
    return F.translate(seq, letters, pairs)


def pair_letter(letter: Column, alphabet: str = "DNA") -> Column:
    """The pair of one letter; a letter that is not of the alphabet is an error."""
    if alphabet == UNLIMITED:
        return letter
    known = (F.length(letter) == 1) & F.contains(F.lit(all_letters(alphabet)), letter)
    return F.when(known, complement(letter, alphabet)).when(letter.isNotNull(), F.raise_error(F.concat(F.lit("no letter of the alphabet: "), letter)).cast("string"))


def revcom(seq: Column, alphabet: str = "DNA") -> Column:
    return F.reverse(complement(seq, alphabet))


# composition


def base_count(seq: Column, letters: str, case_sensitive: bool = False) -> Column:
    """Places that hold one of the letters; a letter that is listed twice counts twice."""
    one = lambda c: F.length(seq) - F.length(F.translate(seq, c if case_sensitive else "".join(dict.fromkeys(c.lower() + c.upper())), ""))
    return sum((one(c) for c in letters[1:]), one(letters[0])) if letters else F.lit(0)


def base_content(seq: Column, letters: str, case_sensitive: bool = False) -> Column:
    """The share of such places; 0 for an empty sequence."""
    return F.when(F.length(seq) == 0, 0.0).otherwise(base_count(seq, letters, case_sensitive) / F.length(seq))


def gc(seq: Column) -> Column:
    """Content of G, C and S (either of both)."""
    return base_content(seq, "gcs")


# windows


def slider(seq: Column, window: int, step: int, circular: bool = False, greedy: bool = False) -> Column:
    """array of struct(start, seq): windows from every step-th place (0-based).

    circular: windows wrap around (and greedy has no effect); greedy: shorter windows at the end are given too.
    """
    n = F.length(seq)
    source = F.concat(seq, F.substring(seq, 1, window - 1)) if circular and window > 1 else seq
    last = n - 1 if circular or greedy else n - window
    places = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return let(source, lambda s: F.transform(places, lambda i: F.struct(i.alias("start"), F.substr(s, i + 1, F.lit(window)).alias("seq"))))


# degenerate letters


def _expansions(protein: bool) -> dict[str, str]:
    """Letter to the letters that it stands for: from the bits of IUPAC, with U beside T."""
    if protein:
        upper = {c: c for c in "ACDEFGHIKLMNPQRSTVWY"} | {"B": "DN", "J": "IL", "Z": "QE", "X": "A-Z"}
    else:
        upper = {c: "".join(b for bit, b in ((1, "A"), (2, "C"), (4, "G"), (8, "TU")) if code & bit) for code, c in enumerate(IUPAC) if code}
        upper["U"] = "TU"
    return upper | {c.lower(): x.lower() for c, x in upper.items()}


def bases_by_letter() -> dict[str, str]:
    """The bases that each nucleotide letter stands for."""
    return _expansions(False)


def _mapped(chars: dict[str, str | list[str]]) -> Column:
    return F.create_map(*[x for c, v in chars.items() for x in (F.lit(c), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])


def degenerate_regexp(seq: Column, protein: bool = False) -> Column:
    """A pattern with a class for every degenerate letter; unknown letters are copied."""
    classes = _mapped({c: x if len(x) == 1 else f"[{x}]" for c, x in _expansions(protein).items()})
    return F.array_join(F.transform(F.split(seq, ""), lambda c: F.coalesce(classes[c], c)), "")


def degenerate_seqs(seq: Column) -> Column:
    """array of all sequences that a degenerate nucleotide sequence stands for; null if it holds another letter. Of sequences that
    stand for many, expansions.expanded() makes rows instead."""
    letters = _mapped({c: list(x) for c, x in _expansions(False).items()})
    grown = F.aggregate(F.filter(F.split(seq, ""), lambda c: c != ""), F.array(F.lit("")), lambda acc, c: F.flatten(F.transform(letters[c], lambda b: F.transform(acc, lambda p: F.concat(p, b)))))
    return F.when(F.rlike(seq, F.lit(f"^[{''.join(_expansions(False))}]*$")), grown)


def base_code(base: Column) -> Column:
    """4-bit code of a base or ambiguous base; gaps 0; others null."""
    upper = F.upper(base)
    return F.when(base.isin(" ", "*", "-"), 0).when(upper == "U", 8).when((F.length(base) == 1) & (F.instr(F.lit(IUPAC), upper) > 1), F.instr(F.lit(IUPAC), upper) - 1)


def ambiguous_base(letters: Column) -> Column:
    """The ambiguous base that stands for all bases of a text; null if it holds another letter."""
    codes = F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), base_code)
    return F.when(F.forall(codes, lambda c: c.isNotNull()), F.substr(F.lit(IUPAC), F.aggregate(codes, F.lit(0), lambda a, c: a.bitwiseOR(c)) + 1, F.lit(1)))


def bases_of(ambiguous: Column) -> Column:
    """The bases (A, C, G, T) that an ambiguous base stands for, as a text."""
    code = base_code(ambiguous)
    return F.concat(*[F.when(code.bitwiseAND(F.lit(bit)) > 0, b).otherwise("") for bit, b in ((1, "A"), (2, "C"), (4, "G"), (8, "T"))])
