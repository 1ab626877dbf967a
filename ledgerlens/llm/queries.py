"""The registered queries of the corpus operators and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, dedup, encode, fingerprint, langid, lengths, lm, mixing, phrases, quality, search, simhash, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_near_dedup": lambda s, d: dedup.op1_near_dedup(table(s, d, "documents")),
        "op2_language": lambda s, d: langid.op2_language(table(s, d, "documents")),
        "op3_lengths": lambda s, d: lengths.op3_lengths(table(s, d, "documents")),
        "op4_search": lambda s, d: search.op4_search(table(s, d, "conversations")),
        "op5_lattice": lambda s, d: lm.op5_lattice(table(s, d, "documents")),
        "op6_encode": lambda s, d: encode.op6_encode(table(s, d, "documents")),
        "op7_fingerprint": lambda s, d: fingerprint.op7_fingerprint(table(s, d, "documents")),
        "op8_mix": lambda s, d: mixing.op8_mix(table(s, d, "documents")),
        "op9_toxicity": lambda s, d: toxicity.op9_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op10_quality": lambda s, d: quality.op10_quality(table(s, d, "documents"), table(s, d, "labels")),
        "op11_audit": lambda s, d: audit.op11_audit(table(s, d, "documents"), table(s, d, "labels")),
        "op12_phrases": lambda s, d: phrases.op12_phrases(table(s, d, "documents")),
        "op13_simhash": lambda s, d: simhash.op13_simhash(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": dedup.OP1_SQL, "op4_search": search.OP4_SQL, "op8_mix": mixing.OP8_SQL, "op11_audit": audit.OP11_SQL, "op12_phrases": phrases.OP12_SQL}
