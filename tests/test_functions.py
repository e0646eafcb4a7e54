"""Column functions on small literals."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqlake.functions import codons, quality
from seqlake.functions import sequence as sq
from seqlake.sources import fastx

CODE_SEQ = "ACGTNacgtn"


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize(("start", "end", "want"), [
    (1, 1, "A"), (2, 4, "CGT"), (-4, -2, "cgt"), (-4, -1, "cgtn"), (-1, -1, "n"), (2, -2, "CGTNacgt"), (1, -1, CODE_SEQ), (12, 14, ""), (-10, -1, CODE_SEQ), (-10, -3, "ACGTNacg"), (3, 12, "GTNacgtn"), (3, 100, "GTNacgtn"),
    (-4, 2, ""), (-3, -4, ""), (-12, -1, CODE_SEQ), (0, 0, CODE_SEQ), (5, 4, ""), (5, 3, ""),
])
def test_sub_seq(spark, start, end, want):
    assert one(spark, sq.sub_seq(F.lit(CODE_SEQ), start, end)) == want


def test_sub_seq_of_nothing(spark):
    assert one(spark, sq.sub_seq(F.lit(""), 1, 2)) == "" and one(spark, sq.sub_seq(F.lit(None).cast("string"), 1, 2)) is None
    assert tuple(one(spark, sq.sub_location(F.lit(10), 11, 12))) == (0, 0, False)
    assert tuple(one(spark, sq.sub_location(F.lit(10), 5, 4))) == (5, 4, True)


def test_validity(spark):
    cases = [("acgt", "DNA", True), ("ACGTRYMKSWHBVDN", "DNAredundant", True), ("acgu", "RNA", True), ("acgturymkswhbvdnz", "RNA", False), ("", "DNA", True), ("ac>", "Protein", False), ("ac>", "Unlimit", True), ("acgt\n", "DNA", False), ("a c-g.t", "DNA", True)]
    assert one(spark, *[sq.is_valid(F.lit(s), a) for s, a, _ in cases]) == tuple(x for *_, x in cases)
    assert one(spark, sq.first_invalid(F.lit("ac>g<"), "DNA")) == ">" and one(spark, sq.first_invalid(F.lit("acg"), "DNA")) is None


def test_alphabets(spark):
    cases = [("acgtACGTn-", "DNA"), ("acguN", "RNA"), ("ACGTRYMK", "DNAredundant"), ("ACGURYMK", "RNAredundant"), ("MKVLEFQ*", "Protein"), ("acgt>", "Unlimit"), ("", "Unlimit"), ("ACGN", "DNA")]
    assert one(spark, *[sq.guess_alphabet(F.lit(s)) for s, _ in cases]) == tuple(x for _, x in cases)
    assert one(spark, sq.guess_alphabet(F.lit("ACGT>"), 4), sq.guess_alphabet(F.lit("ACGT>"), 0), sq.guess_alphabet_broadly(F.lit("ACGT"))) == ("DNA", "Unlimit", "DNAredundant")
    assert len(sq.alphabet_rows()) == len(set(sq.alphabet_rows()))


def test_complements(spark):
    assert one(spark, sq.revcom(F.lit("acgtccn-")), sq.revcom(F.lit("auguccn-"), "RNA"), sq.complement(F.lit("ACGTRYM"), "DNAredundant"), sq.complement(F.lit("MK"), "Protein")) == ("-nggacgt", "-nggacau", "TGCAYRK", "MK")


def test_composition(spark):
    s = F.lit("acgtACGT")
    assert one(spark, sq.base_content(s, "gc"), sq.base_count(s, "g", True), sq.base_count(s, "gg"), sq.gc(F.lit("GCSA")), sq.gc(F.lit("")), sq.bases(F.lit("A-C .G")), sq.remove_gaps(F.lit("A-C .G"))) == (0.5, 1, 4, 0.75, 0.0, 3, "ACG")
    assert tuple(one(spark, sq.remove_gaps_with_quality(F.lit("A-CG"), F.lit("1234")))) == ("ACG", "134")


def test_windows(spark):
    take = lambda *a, **k: [tuple(x) for x in one(spark, sq.slider(F.lit("abcdefg"), *a, **k))]
    assert take(3, 2) == [(0, "abc"), (2, "cde"), (4, "efg")]
    assert take(3, 3, greedy=True) == [(0, "abc"), (3, "def"), (6, "g")]
    assert take(3, 3, circular=True) == [(0, "abc"), (3, "def"), (6, "gab")]
    assert take(8, 1) == []
    assert take(1, 4, circular=True) == [(0, "a"), (4, "e")]


def test_degenerate(spark):
    assert one(spark, sq.degenerate_regexp(F.lit("ARTNz")), sq.degenerate_regexp(F.lit("ABXz"), protein=True)) == ("A[AG][TU][ACGTU]z", "A[DN][A-Z][qe]")
    assert sorted(one(spark, sq.degenerate_seqs(F.lit("AR")))) == ["AA", "AG"] and one(spark, sq.degenerate_seqs(F.lit("A>"))) is None
    assert len(one(spark, sq.degenerate_seqs(F.lit("NN")))) == 25


def test_ambiguous_bases(spark):
    cases = {"ac": "M", "ag": "R", "at": "W", "cg": "S", "ct": "Y", "gt": "K", "acg": "V", "act": "H", "agt": "D", "cgt": "B", "acgt": "N", "A": "A", "u": "T", "mr": "V", "-": "-", "aj": None, "": "-"}
    assert one(spark, *[sq.ambiguous_base(F.lit(s)) for s in cases]) == tuple(cases.values())
    assert one(spark, sq.bases_of(F.lit("N")), sq.bases_of(F.lit("y"))) == ("ACGT", "CT")


def test_translation(spark):
    s = F.lit("ATGGCCTAAATTTGACC")
    assert one(spark, codons.translate(s), codons.translate(s, frame=2), codons.translate(s, frame=3), codons.translate(s, trim=True), codons.translate(s, clean=True)) == ("MA*I*", "WPKFD", "GLNLT", "MA", "MAXIX")
    assert one(spark, codons.translate(s, frame=-1)) == "GQI*A" and one(spark, codons.translate(F.lit("AUGGCC"), rna=True, frame=-1)) == "GH"
    assert one(spark, codons.translate(F.lit("ATNACNYTR---A?G")), codons.translate(F.lit("TTGTAATTGTTG"), mark_start=True), codons.translate(F.lit("TGATTA"), 2)) == ("XTL-X", "M*ML", "WL")
    with pytest.raises(Exception, match="unknown codon"):
        one(spark, codons.translate(F.lit("A?G"), allow_unknown=False))
    with pytest.raises(Exception, match="too short"):
        one(spark, codons.translate(F.lit("AC")))
    with pytest.raises(ValueError, match="frame"):
        codons.translate(s, frame=4)


def test_pairs_of_letters(spark):
    assert one(spark, sq.pair_letter(F.lit("a")), sq.pair_letter(F.lit("U"), "RNA"), sq.pair_letter(F.lit("-"))) == ("t", "A", "-")
    with pytest.raises(Exception, match="no letter"):
        one(spark, sq.pair_letter(F.lit("!")))


def test_records_made_in_code(spark):
    df = spark.createDataFrame([("a", "ACGT", "IIII"), ("b", "AC", None)], "name string, seq string, qual string")
    assert fastx.checked(df, "DNA").count() == 2 and len(fastx.checked(df, "DNA").collect()) == 2
    for row, error in ((("c", "ACG", "II"), "differ"), (("d", "AC!", None), "invalid letter")):
        with pytest.raises(Exception, match=error):
            fastx.checked(spark.createDataFrame([row], df.schema), "DNA").collect()


def test_codon_tables():
    lines = codons.codon_table(1).lines(ambiguous=True)
    assert next(x for x in lines if x[0] == "M") == "M: ATG" and "GGN" in next(x for x in lines if x[0] == "G")
    t = codons.codon_table(1)
    assert (t.get("ATG"), t.get("aun"), t.get("CTN"), t.get("---"), t.get("A?G", True)) == ("M", "X", "L", "-", "X")
    assert t.clone().set("ATG", "Z").get("ATG") == "Z" and t.get("ATG") == "M" and len(codons.CODES) == 24
    assert "Initiation Codons: ATG, CTG, TTG" in str(t) and codons.codon_table(27).stops == {"TGA"}
    for bad in ("AT", "ATGG"):
        with pytest.raises(ValueError, match="three"):
            t.get(bad)
    with pytest.raises(ValueError, match="no codon table"):
        codons.codon_table(7)


@settings(max_examples=15, deadline=None)
@given(st.text("ACGTacgtRYKMSWBDHVN-", min_size=0, max_size=60))
def test_reverse_complement_twice(spark, s):
    assert one(spark, sq.revcom(sq.revcom(F.lit(s), "DNAredundant"), "DNAredundant")) == s


def test_quality(spark):
    q = F.lit("!I~")
    assert one(spark, quality.quality_values(q)) == [0, 40, 93]
    assert one(spark, quality.convert_quality(q, "Illumina-1.8+", "Sanger", force=True), quality.convert_quality(F.lit("BCh"), "Illumina-1.5+", "Sanger"), quality.convert_quality(F.lit("5I"), "Sanger", "Solexa"), quality.convert_quality(q, "Sanger", "Sanger")) == ("!II", "!$I", "Sg", "!I~")
    assert one(spark, quality.mean_quality(F.lit("")), quality.mean_quality(F.lit("IIII"))) == (0.0, pytest.approx(40))
    for v in range(2, 41):
        assert one(spark, quality.solexa_to_phred(quality.phred_to_solexa(F.lit(float(v))))) == pytest.approx(v, abs=0.01)
    with pytest.raises(Exception, match="Phred"):
        one(spark, quality.phred_to_solexa(F.lit(-1.0)))


def test_conversions_by_columns(spark):
    rows = spark.createDataFrame([("!I~", "Sanger", "Solexa"), ("BCh", "Illumina-1.5+", "Sanger"), ("5I", "Sanger", "Solexa"), ("5I", "Unknown", "Solexa"), (None, "Sanger", "Solexa"), ("", "Solexa", "Sanger")], "q string, a string, b string")
    out = rows.select(quality.convert_quality(F.col("q"), F.col("a"), F.col("b")))
    assert [r[0] for r in out.collect()] == [";g\x9c", "!$I", "Sg", "5I", None, ""]
    for bad, source in (("I\u00e9", "Sanger"), ("I I", "Sanger"), ("5", "Solexa")):
        wrong = quality.convert_quality(F.lit(bad), source, "Sanger" if source == "Solexa" else "Solexa")
        with pytest.raises(Exception, match=f"no quality of {source}"):
            one(spark, wrong)
        assert one(spark, F.when(F.lit(bad) == "", wrong)) is None  # only a value that is asked for is an error


def test_conversions_run_outside_the_plan_of_expressions(spark, small):
    """Letters were changed by expressions, for each pair all over again: 126 s for 25 MB."""
    from seqlake.queries import quality_conversions

    plan = quality_conversions(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_replace") <= 6 and "translate(" not in plan.lower()


def test_encodings(spark):
    guess = lambda s: one(spark, quality.guess_encodings(F.lit(s)))
    assert guess("!!I") == ["Sanger", "Illumina-1.8+"]
    assert guess("@Bh") == ["Sanger", "Solexa", "Illumina-1.3+", "Illumina-1.8+"]
    assert guess("BBh") == ["Illumina-1.5+"]
    assert guess("") == ["Sanger", "Solexa", "Illumina-1.3+", "Illumina-1.5+", "Illumina-1.8+"]
