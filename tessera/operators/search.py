"""Lexical search with explicit budgets, ranked text search, vectors, and keyset pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import ResourceLimit
from tessera.functions.values import ascii_lower
from tessera.session import materialize

#: The reference's limit of candidates of one research query.
MAX_CANDIDATES = 65_536


def contains_all(haystack: Column, terms: list[str]) -> Column:
    """Every term is a substring after folding A-Z."""
    folded = ascii_lower(haystack)
    lower = [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in terms]
    return reduce(lambda a, b: a & b, [F.contains(folded, F.lit(t)) for t in lower], F.lit(True))


def search_facts(facts: DataFrame, terms: list[str], max_candidates: int | None = None) -> DataFrame:
    """Facts whose subject, predicate, value and source text hold all terms; too many candidates are an error."""
    if max_candidates is not None and facts.limit(max_candidates + 1).count() > max_candidates:
        raise ResourceLimit(f"more than {max_candidates} candidates")
    return facts.filter(contains_all(F.concat_ws("\n", "subject", "predicate", "value", "source_text"), terms))


def search_claims(claims: DataFrame, terms: list[str], revision: int, max_candidates: int | None = MAX_CANDIDATES) -> DataFrame:
    """Active claims that hold all terms among the first candidates by id; ``truncated`` if there are more of those.

    None as the limit searches all active claims in one scan, without an order.
    """
    active = claims.filter(F.col("status_revision").isNull() | (F.col("status_revision") > revision))
    if max_candidates is None:
        return active.filter(contains_all(F.concat_ws(" ", "subject", "predicate", "value", "excerpts"), terms)).withColumn("truncated", F.lit(False))
    first = active.orderBy("id").limit(max_candidates)
    more = F.lit(active.limit(max_candidates + 1).count() > max_candidates)
    return first.filter(contains_all(F.concat_ws(" ", "subject", "predicate", "value", "excerpts"), terms)).withColumn("truncated", more)


def within_budget(rows: DataFrame, max_results: int, max_bytes: int, partition: list[str] | None = None, order: str = "id") -> DataFrame:
    """The longest prefix by ``order`` that stays within both budgets, per partition; ``truncated`` if cut.

    Only the first max_results + 1 rows of a partition can matter; Spark prunes to them before the sums, without
    a partition by taking the first rows of every task.
    """
    if not partition:
        rows = rows.orderBy(order).limit(max_results + 1)
    by = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(order)
    ranked = rows.withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= max_results + 1)
    summed = ranked.withColumn("_sum", F.sum("bytes").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    over = (F.col("_rank") > max_results) | (F.col("_sum") > max_bytes)
    cut = summed.withColumn("_cut", F.max(over.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("truncated", F.max("_cut").over(Window.partitionBy(*(partition or [F.lit(0)]))) == 1)
    return cut.filter("_cut = 0").drop("_rank", "_sum", "_cut")


def time_filter(event_time: Column, mode: str, value: Column | None = None) -> Column:
    """any, exact (equal) or missing (has no event time)."""
    return {"any": lambda: F.lit(True), "exact": lambda: F.coalesce(event_time == value, F.lit(False)), "missing": lambda: event_time.isNull()}[mode]()


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Score of each document with at least one term, with the share of each term.

    Terms are lower-case letters and digits. Texts are read once: lengths and term frequencies are written, and
    corpus counts are one small aggregate of them; texts aren't shuffled.
    """
    plain = F.btrim(F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[^A-Za-z0-9]+", "  ")))
    padded = F.concat(F.lit("  "), "u", F.lit("  "))
    times = lambda t, part: (F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)
    size = F.when(F.col("u") == "", 0).otherwise(times(F.col("u"), "  ") + 1).cast("long")
    words = docs.select(F.col(id_col), plain.alias("u"))
    rows = materialize(words.select(id_col, size.alias("n"), *[times(padded, f" {term} ").cast("long").alias(f"tf{i}") for i, term in enumerate(terms)]), "frequencies")
    stats = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hit = reduce(lambda a, c: a | c, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    part = lambda i: F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    shares = [part(i).alias(f"share{i}") for i in range(len(terms))]
    return rows.filter(hit).join(F.broadcast(stats)).select(id_col, *shares).withColumn("score", reduce(lambda a, c: a + c, [F.col(f"share{i}") for i in range(len(terms))]))


def vector_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors with the largest cosine to the query (ties: smaller id), exact."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    q = F.array(*map(F.lit, query))
    cosine = dot(F.col(vector_col), q) / F.sqrt(dot(F.col(vector_col), F.col(vector_col)) * dot(q, q))
    return vectors.select(id_col, cosine.alias("cosine")).orderBy(F.desc("cosine"), id_col).limit(k)


def page_after(rows: DataFrame, after: object | None, size: int, order: str = "id") -> DataFrame:
    """A page of rows after a key; the key of the last row is the next cursor."""
    return (rows if after is None else rows.filter(F.col(order) > F.lit(after))).orderBy(order).limit(size)
