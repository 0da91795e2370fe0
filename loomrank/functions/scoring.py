"""Scorers and the quantiser as SQL expressions in single precision.

Every division and logarithm is cast back to FLOAT, so that engines which widen
intermediate results give the same bits.  The expressions use the columns tf, df,
norm_len (FLOAT) and n (documents in the collection).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least inverse document frequency, for terms in more than half of the documents.
IDF_FLOOR = "1e-6"
LARGEST_IMPACT = 65535


class Scorer(Protocol):
    needs_quantization: bool

    def sql(self) -> str: ...


def _f(x: object) -> str:
    return f"CAST({x} AS FLOAT)"


@dataclass(frozen=True)
class BM25:
    k1: float = 0.9
    b: float = 0.4
    needs_quantization = True

    def idf_sql(self) -> str:
        ratio = _f(f"{_f(_f('n - df') + ' + ' + _f('0.5'))} / {_f(_f('df') + ' + ' + _f('0.5'))}")
        return f"GREATEST({_f(f'LN(CAST({ratio} AS DOUBLE))')}, {_f(IDF_FLOOR)}) * ({_f(1)} + {_f(self.k1)})"

    def weight_sql(self) -> str:
        length = f"(({_f(1)} - {_f(self.b)}) + {_f(self.b)} * norm_len)"
        return _f(f"{_f('tf')} / ({_f('tf')} + {_f(self.k1)} * {length})")

    def sql(self) -> str:
        return f"{_f(self.idf_sql())} * {self.weight_sql()}"


@dataclass(frozen=True)
class Identity:
    """Term frequencies are impacts already."""

    needs_quantization = False

    def sql(self) -> str:
        return _f("tf")


@dataclass(frozen=True)
class LinearQuantizer:
    """Scores up to the collection's maximum become levels 1 to 2 ** bits."""

    bits: int = 8

    def __post_init__(self):
        if not 1 <= self.bits <= 15:
            raise ValueError("bits must be from 1 to 15: the maximum maps to 2 ** bits, which has to fit 16 bits")

    def sql(self, score: str = "score", largest: str = "max_score") -> str:
        scale = _f(f"{_f(2**self.bits)} / {largest}")
        return f"CAST(CEIL({score} * {scale}) AS INT)"


def saturated_sql(tf: str = "tf") -> str:
    """The impact of an already quantised posting."""
    return f"CAST(LEAST(GREATEST({tf}, 0), {LARGEST_IMPACT}) AS INT)"


def norm_len_sql(length: str = "doc_len", average: str = "avg_len") -> str:
    """Division in double precision, then single."""
    return f"CAST(CAST({length} AS DOUBLE) / {average} AS FLOAT)"


def score(scorer: Scorer) -> Column:
    return F.expr(scorer.sql())


def rescaled_sql(weight: str, largest: str, limit: int) -> str:
    """Query weights whose maximum is beyond the limit shrink in proportion, rounded up."""
    shrunk = f"CAST(CEIL(CAST(CAST({limit} * {weight} AS FLOAT) / CAST({largest} AS FLOAT) AS FLOAT)) AS INT)"
    return f"CASE WHEN {largest} > {limit} THEN {shrunk} ELSE CAST({weight} AS INT) END"


def fraction_budget_sql(total: str, rho: float) -> str:
    return f"CAST(CEIL(CAST({total} AS FLOAT) * CAST({rho!r} AS FLOAT)) AS BIGINT)"
