"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .codes import op12_vector_codes
from .fingerprint import op5_fingerprint
from .jaccard import op1_jaccard
from .language import op8_language
from .licenses import op3_licenses
from .lm import op4_lm_score
from .mixing import op2_mixing
from .neighbours import op10_neighbours
from .pieces import op7_sentencepiece
from .quality import op6_quality
from .resample import op13_resample
from .toxicity import op9_toxicity
from .warc import op11_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard": op1_jaccard,
        "op2_mixing": op2_mixing,
        "op3_licenses": op3_licenses,
        "op4_lm_score": op4_lm_score,
        "op5_fingerprint": op5_fingerprint,
        "op6_quality": op6_quality,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_language": op8_language,
        "op9_toxicity": op9_toxicity,
        "op10_neighbours": op10_neighbours,
        "op11_warc": op11_warc,
        "op12_vector_codes": op12_vector_codes,
        "op13_resample": op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    """Only of the operators that SQL can express; the others are tested against brute force or by held-out accuracy."""
    return oracles.oracle_sql()
