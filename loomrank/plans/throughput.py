"""Measuring: batches of queries at a rate, and the highest rate that still helps."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from loomrank.operators.planning import EXHAUSTIVE, Mode
from loomrank.plans.index import Index
from loomrank.plans.search import search

ERRORS = 10_000


def timed(f: Callable[[], object]) -> tuple[float, object]:
    start = time.perf_counter()
    out = f()
    return time.perf_counter() - start, out


def run_batch(index: Index, query_terms: DataFrame, k: int = 10, mode: Mode = EXHAUSTIVE) -> tuple[float, int]:
    """Seconds of one batch, and the results it gave."""
    seconds, rows = timed(lambda: search(index, query_terms, k, mode).count())
    return seconds, int(rows)


def rate(log: list[tuple[int, float]]) -> float:
    """Answers a second of a load's log."""
    return sum(n for n, _ in log) / max(sum(t for _, t in log), 1e-9)


def load(batch: Callable[[int], int], tps: int, seconds: float, errors: int = ERRORS) -> list[tuple[int, float]]:
    """Calls batch(tps) once a second for a while: (answered, seconds) of each; stops after too many failures."""
    out: list[tuple[int, float]] = []
    failed, start = 0, time.perf_counter()
    while time.perf_counter() - start < seconds:
        began = time.perf_counter()
        try:
            answered = batch(tps)
        except Exception:
            failed += tps
            if failed > errors:
                raise
            continue
        took = time.perf_counter() - began
        out.append((answered, took))
        time.sleep(max(0.0, min(1.0 - took, seconds - (time.perf_counter() - start))))
    return out


def highest_rate(measure: Callable[[int], float], tps: int = 100, step: int = 100) -> tuple[int, float]:
    """The rate with the best measured throughput: it grows while that helps, else goes back by half a step."""
    best, best_rate = 0.0, tps
    while step > 1:
        got = measure(tps)
        if got > best:
            best, best_rate = got, tps
            tps += step
        else:
            step //= 2
            tps = max(1, tps - step)
    return best_rate, best
