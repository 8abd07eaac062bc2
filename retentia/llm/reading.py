"""Reading level of each document: continuous difficulty propagated over the document-word graph.

Documents and words are the two sides of a graph, an edge weighs how often the word occurs. Graded documents are clamped to
the mean of their grades. A word's difficulty is the mean over its documents, an ungraded document's the mean over its words; these harmonic
updates are repeated until the words move by less than `TOLERANCE` of a level on average. The ungraded side of a word counts at most `KAPPA` occurrences, so it fills in the words that no
graded document has without drowning the grades. At the end the means, drawn together by averaging, are stretched back to
the scale of the grades by a monotone cubic fitted on power sums of the graded documents.

All sums are of whole numbers (values in steps of 1/65536) or decimals: no order of tasks changes a digit.

Words are hashed to `buckets` places, so the state of the graph's word side is a vector of fixed size that is broadcast, and one
iteration is one pass over the documents with map-side sums per bucket: no edge is ever shuffled, and a word that is in every
document or a paper with a third of all rows costs nothing extra. The edges are written once to the shared folder.

Defined results: a document without words has no estimate (null level); grades outside 1 to 5 or null are ignored; without any graded
document there are no estimates; several rows with one id are estimated each; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.common import materialize

BUCKETS, KAPPA, TOLERANCE, MOST = 1 << 18, 3.0, 0.002, 30
_STEP = 65536.0
_WORD = re.compile(r"[^\W\d_]+")
_EDGES = "doc_id bigint, ids array<int>, counts array<int>"
_SUMS = "bucket int, s bigint, n bigint"


def edges(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row per document: its word buckets and how often each occurs in the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in batches:
            ids, counts = [], []
            for t in b.column(1).to_pylist():
                c: Counter = Counter()
                for w, n in Counter(_WORD.findall(t.lower())).items() if t else ():
                    k = memo.get(w)
                    if k is None:
                        if len(memo) > 1_000_000:
                            memo.clear()
                        k = memo[w] = xxhash.xxh64_intdigest(w) % buckets
                    c[k] += n
                ids.append(list(c))
                counts.append(list(c.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "ids", "counts"])

    return materialize(documents.select(F.col(doc_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _EDGES))


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, counts = b.column("ids"), b.column("counts")
    sizes = np.diff(ids.offsets.to_numpy())
    return np.repeat(np.arange(len(ids)), sizes), ids.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False).astype(float)


def _estimates(b: pa.RecordBatch, words: np.ndarray) -> np.ndarray:
    """Mean over the words of every document; nan without words."""
    row, ids, n = _arrays(b)
    with np.errstate(invalid="ignore"):
        return np.bincount(row, n * words[ids], minlength=b.num_rows) / np.bincount(row, n, minlength=b.num_rows)


def _sum_by_word(table: DataFrame, words: np.ndarray | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket: sum of count x value and sum of counts; the value is the grade, or the estimate from `words`."""
    shared = None if words is None else table.sparkSession.sparkContext.broadcast(words)  # one double a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, m = np.zeros(buckets), np.zeros(buckets)  # whole numbers, exact in doubles up to 2^53
        for b in batches:
            if b.num_rows:
                value = np.nan_to_num(_estimates(b, shared.value)) if shared else b.column("grade").to_numpy(zero_copy_only=False)
                row, ids, n = _arrays(b)
                s += np.bincount(ids, n * np.rint(value * _STEP)[row], minlength=buckets)
                m += np.bincount(ids, n, minlength=buckets)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(s[at].astype(np.int64)), pa.array(m[at].astype(np.int64))], names=["bucket", "s", "n"])

    got = table.mapInArrow(run, _SUMS).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()  # at most one row a bucket
    s, m = np.zeros(buckets), np.zeros(buckets)
    at = got.column("bucket").to_numpy()
    s[at], m[at] = got.column("s").to_numpy() / _STEP, got.column("n").to_numpy()
    return s, m


def propagate(table: DataFrame, graded: DataFrame, kappa: float = KAPPA, buckets: int = BUCKETS, tolerance: float = TOLERANCE, most: int = MOST) -> np.ndarray | None:
    """Difficulty of every word bucket, or None without graded documents."""
    gs, gn = _sum_by_word(graded, None, buckets)
    if not gn.any():
        return None
    middle = gs.sum() / gn.sum()
    words = (gs + middle) / (gn + 1)
    for _ in range(most):
        s, n = _sum_by_word(table, words, buckets)
        own_s, own_n = _sum_by_word(graded, words, buckets)
        n, s = np.maximum(n - own_n, 0), s - own_s  # the ungraded documents
        mean = np.divide(s, n, out=np.full(buckets, middle), where=n > 0)
        k = np.minimum(n, kappa)
        new = (gs + k * mean + 0.01 * middle) / (gn + k + 0.01)
        moved = np.average(np.abs(new - words), weights=gn + k + 1e-9)
        words = new
        if moved < tolerance:
            break
    return words


def estimates(table: DataFrame, words: np.ndarray) -> DataFrame:
    """(doc_id, raw): mean word difficulty of every document, null without words."""
    shared = table.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                e = _estimates(b, shared.value)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(e, from_pandas=True)], names=["doc_id", "raw"])

    return table.mapInArrow(run, "doc_id bigint, raw double")


def calibration(graded: DataFrame, words: np.ndarray) -> tuple[float, float, float, list[float]]:
    """(low, high, centre, coefficients): cubic from means to grades by least squares on power sums; a line where the cubic would turn."""
    e = estimates(graded, words).where("raw is not null").join(graded.select("doc_id", "grade"), "doc_id")
    exact = lambda c: F.sum(c.cast("decimal(38,15)")).cast("double")
    lo, hi, total, n = e.agg(F.min("raw"), F.max("raw"), exact(F.col("raw")), F.count("*")).first()
    mid = total / n
    x = F.col("raw") - F.lit(mid)
    p = e.agg(*[exact(F.pow(x, k)).alias(f"x{k}") for k in range(7)], *[exact(F.pow(x, k) * F.col("grade")).alias(f"y{k}") for k in range(4)]).first()

    def fit(d: int) -> np.ndarray:
        return np.linalg.lstsq(np.array([[p[f"x{i + j}"] for j in range(d + 1)] for i in range(d + 1)]), np.array([p[f"y{i}"] for i in range(d + 1)]), rcond=None)[0]

    c = fit(3)
    at = np.linspace(lo - mid, hi - mid, 200)
    if (c[1] + 2 * c[2] * at + 3 * c[3] * at**2 < 0).any():
        c = fit(1)
    return float(lo), float(hi), float(mid), [float(v) for v in c]


def reading_levels(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, difficulty, level): continuous estimate on the scale of the grades, and the nearest of 1 to 5."""
    table = edges(documents, buckets=buckets)
    grades = labels.where("reading_level between 1 and 5 and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("reading_level").alias("grade"))
    graded = materialize(table.join(grades, "doc_id").where(F.size("ids") > 0))
    words = propagate(table, graded, buckets=buckets)
    if words is None:
        return table.select("doc_id", F.lit(None).cast("double").alias("difficulty"), F.lit(None).cast("int").alias("level"))
    lo, hi, mid, c = calibration(graded, words)
    x = F.greatest(F.least(F.col("raw"), F.lit(hi)), F.lit(lo)) - F.lit(mid)
    y = F.lit(0.0)
    for v in reversed(c):
        y = y * x + F.lit(v)
    y = F.when(F.col("raw").isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(5.0), y)))
    return estimates(table, words).select("doc_id", y.alias("difficulty"), F.floor(y + 0.5).cast("int").alias("level"))
