"""Which segments a query reads, in which order, and how far a postings budget goes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrank.functions.scoring import fraction_budget_sql


@dataclass(frozen=True)
class Mode:
    """How much of a query's postings may be read: a share from 0 to 1, or a fixed number."""

    fraction: float | None = None
    fixed: int | None = None

    def __post_init__(self):
        if (self.fraction is None) == (self.fixed is None):
            raise ValueError("a mode is a fraction or a fixed budget")
        if self.fraction is not None and not 0 <= self.fraction <= 1:
            raise ValueError("the fraction must be from 0 to 1")

    @property
    def exhaustive(self) -> bool:
        return self.fraction == 1

    @classmethod
    def parse(cls, text: str) -> Mode:
        """`fraction-0.5` or `fixed-1000`."""
        kind, dash, value = text.partition("-")
        if not dash or "-" in value:
            raise ValueError(f"{text!r} isn't <mode>-<value>")
        if kind == "fraction":
            return cls(fraction=float(value))
        if kind == "fixed":
            if not value.isdigit():
                raise ValueError(f"{value!r} isn't a number of postings")
            return cls(fixed=int(value))
        raise ValueError(f"{kind!r} is neither fraction nor fixed")


EXHAUSTIVE = Mode(fraction=1.0)


def planned(directory: DataFrame, query_terms: DataFrame) -> DataFrame:
    """qid, pos, token, impact, weight, count and level of the segments of known tokens.

    Only counts travel here, never lists of ids.  Tokens that repeat each count.
    """
    terms = query_terms.select("qid", "pos", "token", "weight")
    found = directory.select("term", "impact", "count").join(terms, F.col("term") == F.col("token"))
    return found.select("qid", "pos", "token", "impact", "weight", "count", (F.col("impact").cast("long") * F.col("weight")).alias("level"))


def unknown(directory: DataFrame, query_terms: DataFrame) -> DataFrame:
    """qid and token of tokens that the index doesn't have."""
    return query_terms.join(directory.select(F.col("term").alias("token")).distinct(), "token", "left_anti").select("qid", "token")


def postings_per_query(plan: DataFrame) -> DataFrame:
    return plan.groupBy("qid").agg(F.sum("count").alias("postings"))


def with_prior(plan: DataFrame) -> DataFrame:
    """The postings of all segments before each one (levels descending, then token position), and of the whole query."""
    own = Window.partitionBy("qid")
    before = own.orderBy(F.desc("level"), "pos", F.desc("impact")).rowsBetween(Window.unboundedPreceding, -1)
    return plan.withColumn("prior", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumn("total", F.sum("count").over(own))


def selected(plan: DataFrame, mode: Mode) -> DataFrame:
    """The segments to process: whole ones, as long as the postings before them are within the budget."""
    if mode.exhaustive:
        return plan
    budget = F.expr(fraction_budget_sql("total", mode.fraction)) if mode.fraction is not None else F.lit(mode.fixed).cast("long")
    return with_prior(plan).where(F.col("prior") <= budget).drop("prior", "total")


def cuts(selected: DataFrame) -> DataFrame:
    """qid, pos, token, weight and cut: the segments to process of one token are those of impact `cut` and more.

    Segments go by level, and of one token by impact, so what a budget takes of a
    token is always its highest segments.
    """
    return selected.groupBy("qid", "pos", "token", "weight").agg(F.min("impact").alias("cut"))


def uncut(query_terms: DataFrame) -> DataFrame:
    """The cuts of an exhaustive search, which needs no plan."""
    return query_terms.select("qid", "pos", "token", "weight", F.lit(0).alias("cut"))


def bands(plan: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """qid, pos, token, weight, and for each share the lowest impact within it (cut_i) and the highest beyond it (next_i; 0 if none).

    plan: with_prior()'s.  A segment is within a share if it ends within it, so the
    long lists at the end stay out of all but the last.  A token with nothing within
    a share has a cut above its highest impact.
    """
    columns = []
    for i, share in enumerate(shares):
        within = F.col("prior") + F.col("count") <= share * F.col("total")
        columns.append(F.coalesce(F.min(F.when(within, F.col("impact"))), F.max("impact") + 1).alias(f"cut_{i}"))
        columns.append(F.coalesce(F.max(F.when(~within, F.col("impact"))), F.lit(0)).alias(f"next_{i}"))
    return plan.groupBy("qid", "pos", "token", "weight").agg(*columns, F.max("impact").alias("most"))


def cells(cuts: DataFrame, tops: DataFrame) -> DataFrame:
    """qid, term, weight, cut, block and top: the blocks where a token has segments to process."""
    found = tops.select("term", "block", "top").join(cuts.select("qid", F.col("token").alias("term"), "weight", "cut"), "term")
    return found.where("top >= cut").select("qid", "term", "weight", "cut", "block", "top")


def warmup(directory: DataFrame, tokens: DataFrame) -> DataFrame:
    """The highest segment of each token: what a budget of zero reads."""
    top = directory.join(tokens.select(F.col("token").alias("term")).distinct(), "term").groupBy("term").agg(F.max(F.struct("impact", "count")).alias("top"))
    return top.select("term", "top.impact", "top.count")
