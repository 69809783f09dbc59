"""Quality classifier: a regularised quadratic discriminant over document statistics.

Every whole text is reduced to a few transformed statistics (Arrow, numpy). Class sizes,
sums and products are added up over all labelled training rows, so the fit needs two small
matrices and no rows on the driver (and a histogram of fixed size for the cut). Class covariances are shrunk towards a sphere (oracle
approximating shrinkage plus a floor), their Cholesky factors are computed once and travel
with the scoring function; a score is the logistic value of the difference of the two
log-densities, each a Mahalanobis distance through its factor, per dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quire.llm.quality_rules import _ddl, measure_texts
from quire.llm.text import mix, per_text, row, slices, utf8, words
from quire.session import settle

FEATURES = (
    "log_words", "chars_per_word", "symbols", "punctuation", "capitals", "digits", "distinct", "top_word",
    "dup_lines", "repeats", "stops", "short_words", "lines",
)
LEAST_SHRINKAGE = 0.05
LEAST_VARIANCE = 1e-4


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Share on a logarithmic scale with a floor of about 0.2 %, so that small shares count and none is infinite."""
    return np.log(np.clip(part / np.maximum(whole, 1), 0, 1) + 0.002)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text; a null or empty text has finite values too."""
    n = len(texts)
    base = measure_texts(texts)
    data, offsets = utf8(texts)
    start, end, text, hashes = words(data, offsets, fold=True)

    def count(low: int, high: int, *more: tuple[int, int]) -> np.ndarray:
        flag = np.zeros(256, bool)
        for a, b in ((low, high), *more):
            flag[a : b + 1] = True
        total = np.concatenate([[0], np.cumsum(flag[data], dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    n_words, chars = base["n_words"], base["word_chars"]
    key = mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, text[first], counts)
    letters = count(65, 90, (97, 122), (194, 244))
    return np.column_stack(
        [
            np.log1p(n_words),
            np.log1p(chars / np.maximum(n_words, 1)),
            _share(base["n_symbols"], chars),
            _share(count(33, 34, (39, 41), (44, 44), (58, 59), (63, 63)), chars),
            _share(count(65, 90), letters),
            _share(count(48, 57), chars),
            np.log1p(per_text(None, text[first], n)) - np.log1p(n_words),
            _share(top, n_words),
            _share(base["n_dup_lines"], base["n_lines"]),
            _share(base["n_repeat_words"], n_words),
            _share(count(46, 46), n_words),
            _share(per_text(None, text[end - start <= 3], n), n_words),
            np.log1p(base["n_lines"]) - np.log1p(n_words),
        ]
    )


def with_statistics(docs: DataFrame, carry: list[str], text: str = "text", order: str = "doc_id") -> DataFrame:
    """(row, id, x): the statistics of every row's text as an array."""
    chosen = docs.select(
        row(docs, carry).alias("row"), docs[f"`{order}`"].alias("id"), docs[f"`{text}`"].cast("string").alias("text")
    )
    out = chosen.drop("text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = statistics(part.column("text"))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), lists], ["row", "id", "x"])

    return chosen.mapInArrow(measure, f"{_ddl(out)}, x array<double>")


@dataclass
class Discriminant:
    """Two class densities in standardised coordinates; ``factors`` are inverse Cholesky factors."""

    center: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    log_det: tuple[float, float]
    log_prior: float
    cut: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density difference per dimension."""
        z = (x - self.center) / self.scale
        far = [((z - m) @ f.T) for m, f in zip(self.means, self.factors)]
        log_density = [-0.5 * (d * d).sum(axis=1) - ld for d, ld in zip(far, self.log_det)]
        return (log_density[1] - log_density[0] + self.log_prior) / len(self.center)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.difference(x) - self.cut, -700, 700)))


@dataclass
class Constant:
    """Without both classes in the training rows: the smoothed share of label 1."""

    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def _shrunk(cov: np.ndarray, n: int) -> np.ndarray:
    """Oracle approximating shrinkage towards a sphere, at least ``LEAST_SHRINKAGE``."""
    d = len(cov)
    square, trace = float((cov * cov).sum()), float(np.trace(cov))
    bottom = (n + 1 - 2 / d) * (square - trace * trace / d)
    rho = 1.0 if bottom <= 0 else min(1.0, ((1 - 2 / d) * square + trace * trace) / bottom)
    rho = max(rho, LEAST_SHRINKAGE)
    return (1 - rho) * cov + rho * max(trace / d, LEAST_VARIANCE) * np.eye(d)


def moments(labelled: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """(n, sum, sum of products) of ``x`` by ``label``; added up by Spark, a few hundred numbers in all."""
    d = len(FEATURES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, d)
            y = np.asarray(batch.column(1))
            for label in (0, 1):
                z = x[y == label]
                if len(z):
                    v = np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label] * len(v), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)],
                        ["label", "k", "v"],
                    )

    sums = labelled.select("x", "label").mapInArrow(add, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["label"], np.zeros(1 + d + d * d))[r["k"]] = r["v"]
    return {y: (int(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d)) for y, v in out.items()}


def fit(labelled: DataFrame) -> Discriminant | Constant:
    """Fit on rows (x, label in {0, 1}); all rows count."""
    found = moments(labelled)
    n = [found[y][0] if y in found else 0 for y in (0, 1)]
    if min(n) < 2:
        return Constant((n[1] + 1) / (sum(n) + 2))
    mean = [found[y][1] / n[y] for y in (0, 1)]
    cov = [found[y][2] / n[y] - np.outer(mean[y], mean[y]) for y in (0, 1)]
    center = (found[0][1] + found[1][1]) / sum(n)
    scale = np.sqrt(np.maximum((n[0] * np.diag(cov[0]) + n[1] * np.diag(cov[1])) / sum(n), LEAST_VARIANCE))
    factors, log_det = [], []
    for y in (0, 1):
        lower = np.linalg.cholesky(_shrunk(cov[y] / np.outer(scale, scale), n[y]))
        factors.append(np.linalg.inv(lower))
        log_det.append(float(np.log(np.diag(lower)).sum()))
    means = tuple((m - center) / scale for m in mean)
    model = Discriminant(center, scale, means, tuple(factors), tuple(log_det), float(np.log(n[1] / n[0])))
    model.cut = _best_cut(labelled, model)
    return model


def _best_cut(labelled: DataFrame, model: Discriminant, steps: int = 50, reach: int = 2000) -> float:
    """The difference that tells the training labels apart with the fewest errors, from a histogram of fixed size."""

    @F.pandas_udf(DoubleType())
    def difference(x: pd.Series) -> pd.Series:
        return pd.Series(model.difference(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    step = F.least(F.greatest(F.floor(difference("x") * steps), F.lit(-reach)), F.lit(reach - 1))
    counts = np.zeros((2, 2 * reach))
    for r in labelled.groupBy("label", step.alias("step")).count().collect():
        counts[r["label"], r["step"] + reach] = r["count"]
    none = np.zeros(1)
    errors = np.concatenate([none, np.cumsum(counts[1])]) + np.concatenate([np.cumsum(counts[0][::-1])[::-1], none])
    best = np.flatnonzero(errors == errors.min())
    return float(best[len(best) // 2] - reach) / steps


def held_out(doc_id) -> F.Column:
    """Rows kept out of the fit: crc32 of the id as text is 1 modulo 3; null ids are not."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def score_quality(
    docs: DataFrame, labels: DataFrame, carry: list[str], text: str = "text", order: str = "doc_id", label: str = "quality"
) -> DataFrame:
    """(row, held_out, score, predicted) for every row of ``docs``.

    Of ``labels`` only rows with an id, a 0/1 label and a training id are used; an id with several
    labels has the majority (ties: 1), and counts once per document row with that id. With fewer
    than two training rows of a class, every score is the smoothed share of label 1.
    """
    measured = settle(with_statistics(docs, carry, text, order), "quality-statistics")
    id_, y = labels[order], labels[label]
    known = (
        labels.where(id_.isNotNull() & y.isin(0, 1) & ~held_out(id_))
        .groupBy(id_.alias("label_id")).agg((F.avg(y.cast("double")) >= 0.5).cast("int").alias("label"))
    )
    model = fit(measured.join(known, F.col("id") == F.col("label_id")))

    @F.pandas_udf(DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    return measured.select("row", held_out(F.col("id")).alias("held_out"), score("x").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects; same columns."""
    scored = score_quality(docs, labels, docs.columns, text)
    return scored.where("predicted = 1").select(*[F.col("row")[c].alias(c) for c in docs.columns])
