"""Toxicity by non-negative positive-unlabelled learning.

Inputs are the presence of hashed words and word beginnings. Linear classifiers in numpy are trained on
confirmed toxic and unlabelled documents by the risk ``pi R_p(+) + max(0, R_u(-) - pi R_p(-))`` with the class
prior ``pi``, the share of toxic labels among training labels; the non-negative part keeps the flexible model
from fitting the unlabelled set away. The score is the mean of the classifiers' probabilities.

The classifiers are fitted on a bounded sample of rows: about ``max_positive`` confirmed toxic and
``max_unlabelled`` unlabelled documents, picked by a hash of the id, whole texts of them. Their features are
written once; which ones a classifier looks at (at most ``max_features``, a size of the model) is decided on
that sample, by how much more frequent they are in toxic documents than chance allows. Documents are read
twice: for the sample and for the scores (and their ids once, for the sampling rate); scoring covers whole
texts of all rows.

Defined cases: a null or empty text has no feature and gets the score of the bias; very long texts are whole,
each a block of its own; without a confirmed toxic document every score is 0, and if none has a text in
``docs`` too; a null id is in the held-out fold; each row is scored, ties and repeats alike; an empty table
gives none; a document with several labels counts as toxic if one says so; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm._bytes import row_blocks, row_of, text_column, trimmed, words
from tessera.llm._fit import fold
from tessera.session import materialize, ship

PREFIXES = (4, 5, 6, 8)


def row_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of words and of their beginnings (with repeats)."""
    _, _, counts, *hashes = words(buf, offsets, prefixes=PREFIXES)
    row = row_of(counts)
    return np.tile(row, len(hashes)), np.concatenate(hashes)


def known_features(buf: np.ndarray, offsets: np.ndarray, sorted_hashes: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place in ``sorted_hashes``) of the features that are in it."""
    row, h = row_features(buf, offsets)
    maybe = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
    row, h = row[maybe], h[maybe]
    at = np.minimum(np.searchsorted(sorted_hashes, h), max(0, len(sorted_hashes) - 1))
    good = sorted_hashes[at] == h if len(sorted_hashes) else np.zeros(0, bool)
    n = max(1, len(sorted_hashes))
    pairs = np.unique(row[good] * n + at[good])
    return pairs // n, pairs % n


def _filter(hashes: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << 20, bool)
    seen[(hashes >> np.uint64(44)).astype(np.int64)] = True
    return seen


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier by full-batch Adam on the non-negative risk (logistic loss); both classes have rows."""
    rng = np.random.default_rng(seed)
    w = np.append(rng.normal(0, 0.01, x.shape[1]), -1.0)
    m, v = np.zeros_like(w), np.zeros_like(w)
    xp, xu = x[positive], x[~positive]
    for t in range(1, steps + 1):
        gp, gu = xp @ w[:-1].astype(np.float32) + w[-1], xu @ w[:-1].astype(np.float32) + w[-1]
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        dp, du = prior * (sp - 1) / len(gp), np.zeros_like(gu)  # of pi R_p(+)
        if negative >= 0:
            dp, du = dp - prior * sp / len(gp), su / len(gu)
        else:  # step back from the negative part
            dp, du = prior * sp / len(gp), -su / len(gu)
        grad = np.append(dp.astype(np.float32) @ xp + du.astype(np.float32) @ xu, dp.sum() + du.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, max_positive: int = 6_000, max_unlabelled: int = 12_000, max_features: int = 512, classifiers: int = 3, whole: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; with ``whole`` also the row itself as a struct ``document``."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    carried = [F.struct("*").alias("document")] if whole else []
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"), *carried)
    names, inner = ["document"] if whole else [], docs.columns.index(text_col)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("y is not null and id is not null").filter(fold(F.col("id"), 5) != 0).groupBy("id").agg(F.max("y").alias("y"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    nothing = texts.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *names)
    if not toxic:
        return nothing
    prior = min(0.95, toxic / n)
    slot = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "id"), 11) / float(1 << 53)
    chosen = known.filter("y = 1").filter(slot < max_positive / toxic).select("id", F.lit(True).alias("p"))  # about max_positive ids
    training = F.col("id").isNotNull() & (fold(F.col("id"), 5) != 0)
    n_rows = texts.filter(training).count()
    marked = texts.filter(training).join(F.broadcast(chosen), "id", "left").select("t", F.coalesce("p", F.lit(False)).alias("p"), (slot < max_unlabelled / max(1, n_rows)).alias("u"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_column(batch.column(0))
            for i, j in row_blocks(offsets, 1 << 19):
                row, h = row_features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
                row, h = row[new], h[new]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([lists, *(c.slice(i, j - i) for c in batch.columns[1:])], names=["f", "p", "u"])

    sample = materialize(marked.filter("p or u").mapInArrow(trimmed(features), "f array<long>, p boolean, u boolean"), "sample")
    n_p, n_u = sample.agg(F.count_if("p"), F.count_if("u")).first()
    if not n_p or not n_u:
        return nothing
    least = max(3, int(0.002 * n_p))
    tally = sample.select(F.explode("f").alias("h"), "p", "u").groupBy("h").agg(F.count_if("p").alias("held"), F.count_if("u").alias("seen")).filter(F.col("held") >= least)
    n_candidates = tally.count()
    held, expected = F.col("held"), (F.col("seen") + 1) / F.lit(float(n_u)) * F.lit(float(n_p))
    # a feature of toxic documents only is at most 1 / prior times as frequent among them as in all text;
    # the likelihood ratio must also be beyond what the best of so many candidates reaches by chance
    gain = held * F.log(F.greatest(held / expected, F.lit(1.0))) - F.greatest(held - expected, F.lit(0.0))
    good = (held / expected > max(1.2, 0.4 / prior)) & (gain > float(np.log(max(2, n_candidates)) + 4))
    best = tally.filter(good).select("h", gain.alias("gain")).orderBy(F.desc("gain"), "h").limit(max_features).select("h").collect()
    chosen_hashes = np.sort(np.array([r["h"] for r in best], np.int64).view(np.uint64))
    wanted = F.array(*[F.lit(int(h)) for h in chosen_hashes.view(np.int64)]).cast("array<long>")
    found = sample.select(F.array_intersect("f", wanted).alias("f"), "p", "u").toPandas()
    place = {h: i for i, h in enumerate(chosen_hashes.view(np.int64).tolist())}
    rows_p, rows_u = ([[place[h] for h in f] for f in found["f"][found[c]]] for c in ("p", "u"))  # a toxic one may be in both
    x = np.zeros((len(rows_p) + len(rows_u), len(chosen_hashes)), np.float32)
    for i, at in enumerate(rows_p + rows_u):
        x[i, at] = 1
    positive = np.arange(len(x)) < len(rows_p)
    fitted = [fit_nnpu(x, positive, prior, seed=s) for s in range(classifiers)]
    model = spark.sparkContext.broadcast((chosen_hashes, np.array([w for w, _ in fitted]), np.array([b for _, b in fitted])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_hashes, w, b = model.value
        seen = _filter(known_hashes)
        for batch in batches:
            buf, offsets = text_column(pc.struct_field(batch.column(1), [inner]) if whole else batch.column(1))
            out = [np.zeros(0)]
            for i, j in row_blocks(offsets):
                r, at = known_features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], known_hashes, seen)
                logits = np.array([np.bincount(r, weights=wk[at], minlength=j - i) + bk for wk, bk in zip(w, b)])
                out.append((1 / (1 + np.exp(-np.clip(logits, -500, 500)))).mean(axis=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out)), *batch.columns[1 : 1 + whole]], names=["doc_id", "score", *names])

    schema = StructType.fromDDL(f"doc_id {kind}, score double")
    rows = texts.select("id", *(names or ["t"]))  # a whole row has its text inside, so it is sent once
    scored = rows.mapInArrow(trimmed(score), StructType(schema.fields + rows.schema.fields[1 : 1 + whole]))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *names)
