"""Toxicity: a cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetscope.llm.shared import bounded_sample, cut, free_name, text_slices

#: Labelled rows that the model is fitted on, those with the least hashes of their texts.
TRAINING_ROWS = 20_000
#: Words that are features: those whose presence tells most about the grade.
FEATURES = 2_048
#: A word must occur in so many training rows.
LEAST_ROWS = 5
RIDGE = 1.0
#: Conjugate gradient steps that one Newton step may take.
INNER_STEPS = 200
#: Expected severity from which a document is toxic at the latest; see :func:`toxic_limit`.
TOXIC_FROM = 0.5
#: One labelled row in so many is held out to choose that limit.
HELD_OUT = 5
WORD_PATTERN = r"[^\p{L}]+"


@dataclass
class OrdinalModel:
    """``P(grade > j) = sigmoid(w.x - threshold_j)``: one weight vector for all thresholds, which rise."""

    words: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def expected(self, score: np.ndarray) -> np.ndarray:
        """Expected grade: the sum of the chances of exceeding each threshold."""
        return (1.0 / (1.0 + np.exp(-(score[:, None] - self.thresholds[None, :])))).sum(axis=1)


def words_in(text):
    """Distinct lower-case words of a text column."""
    return F.array_distinct(F.filter(F.split(F.lower(text), WORD_PATTERN), lambda w: w != ""))


def severity_grades(labelled: DataFrame, toxic: str = "toxic", text: str = "text") -> DataFrame:
    """Grades for tables that only say toxic or not: 0 where not; else 1, or 2 where a larger share of
    the words than in the middle toxic row are words that mark toxic rows. A word marks them if it
    is in at least :data:`LEAST_ROWS` of them and in fewer than one row in twenty of the others for each of them. The
    second grade is thus made of words that are features of the model too; labels alone tell the first.

    Adds ``grade``; null where the label or text is null. Counts cover the rows given.
    """
    every, part = free_name(labelled.columns, "words"), free_name(labelled.columns, "share")
    rows = labelled.withColumn(every, words_in(text))
    seen = rows.filter(F.col(toxic).isNotNull()).select(F.explode(every).alias("word"), F.col(toxic).alias("toxic")).groupBy("word").agg(
        F.count_if(F.col("toxic") > 0).alias("bad"), F.count_if(F.col("toxic") <= 0).alias("good")
    )
    marks = seen.filter((F.col("bad") >= LEAST_ROWS) & (F.col("bad") > 20 * F.col("good"))).orderBy(F.desc("bad"), "word").limit(FEATURES)
    listed = [r.word for r in marks.collect()]
    share = F.size(F.array_intersect(every, F.split(F.lit(" ".join(listed)), " "))) / F.greatest(F.size(every), F.lit(1))
    rows = rows.withColumn(part, share)
    middle = rows.filter(F.col(toxic) > 0).agg(F.percentile_approx(part, 0.5).alias("m")).first().m or 0.0
    grade = F.when(F.col(toxic).isNull() | F.col(text).isNull(), F.lit(None)).when(F.col(toxic) <= 0, 0).when(F.col(part) > middle, 2).otherwise(1)
    return rows.withColumn("grade", grade.cast("int")).drop(every, part)


def toxic_limit(model: OrdinalModel, held: DataFrame, toxic: str = "toxic", text: str = "text", rows: int = TRAINING_ROWS) -> float:
    """The expected severity from which a text counts as toxic: the one with the best F1 on labelled rows that the
    model has not seen, in the middle between two of their severities; :data:`TOXIC_FROM` at most, and where
    ``held`` lacks either kind. At most ``rows`` rows come to the driver."""
    known = held.select(F.col(text).alias("text"), (F.col(toxic) > 0).alias("toxic")).filter("text IS NOT NULL AND toxic IS NOT NULL")
    scored = score_severity(bounded_sample(known, rows, "text", "toxic"), model).select("severity", "toxic").collect()
    severity, bad = np.array([r.severity for r in scored]), np.array([r.toxic for r in scored], dtype=bool)
    if not bad.any() or bad.all():
        return TOXIC_FROM
    order = np.argsort(severity)
    severity, bad = severity[order], bad[order]
    hits = bad.sum() - np.concatenate([[0], np.cumsum(bad)])[:-1]  # toxic rows from each place on
    best = 2 * hits / (np.arange(len(bad), 0, -1) + bad.sum())
    best[np.concatenate([[False], severity[1:] == severity[:-1]])] = -1
    place = int(np.flatnonzero(best == best.max())[-1])
    below = severity[place - 1] if place else 0.0
    return float(min(TOXIC_FROM, (below + severity[place]) / 2))


def fit_ordinal(
    graded: DataFrame, text: str = "text", grade: str = "grade", rows: int = TRAINING_ROWS, features: int = FEATURES
) -> OrdinalModel:
    """Fits the model on the ``rows`` graded rows with the least hashes of their texts.

    Spark counts words by grade in the sample and keeps the ``features`` with the largest
    mutual information with the grade; only the kept features of the bounded sample come to the driver,
    where penalised Newton steps fit one weight per word and the thresholds. Grades are whole
    numbers from 0; rows with a null grade or text are left out, empty texts count. With fewer than two
    grades the model always expects the one grade (0 for an empty table).
    """
    usable = graded.filter(F.col(grade).isNotNull() & F.col(text).isNotNull())
    usable = usable.select(F.col(text).alias("text"), F.col(grade).cast("int").alias("grade"))
    sample = bounded_sample(usable, rows, "text", "grade")
    sample = cut(sample.select("grade", words_in("text").alias("words"), F.monotonically_increasing_id().alias("row")))
    grades = {r.grade: r["count"] for r in sample.groupBy("grade").count().collect()}
    levels = sorted(grades)
    if len(levels) < 2:
        return OrdinalModel([], np.empty(0), np.full(levels[0] if levels else 0, -50.0))
    total = sum(grades.values())
    words = sample.select("grade", F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("grade") == g).alias(f"g{g}") for g in levels]
    )
    gain = F.lit(0.0)
    for g in levels:
        share = grades[g] / total
        for inside, base in ((F.col(f"g{g}"), F.col("n")), (F.lit(grades[g]) - F.col(f"g{g}"), F.lit(total) - F.col("n"))):
            gain = gain + F.when((inside > 0) & (base > 0), inside / total * F.log(inside / base / share)).otherwise(0.0)
    chosen = words.filter(F.col("n") >= LEAST_ROWS).orderBy(gain.desc(), "word").limit(features)
    listed = [r.word for r in chosen.collect()]
    index = {word: i for i, word in enumerate(listed)}
    kept = F.array_intersect("words", F.split(F.lit(" ".join(listed)), " "))
    found = sample.select("grade", kept.alias("words")).orderBy("grade", "words").toLocalIterator()
    grade_of, ends, places = [], [0], array("i")
    for row in found:
        grade_of.append(row.grade)
        places.extend(sorted(index[w] for w in row.words if w))
        ends.append(len(places))
    return OrdinalModel(listed, *_newton(_Design(np.array(places, dtype=np.int64), np.array(ends), len(listed)), np.array(grade_of), max(levels)))


@dataclass
class _Design:
    """A matrix of zeros and ones: row ``i`` has ones at ``places[ends[i]:ends[i + 1]]``."""

    places: np.ndarray
    ends: np.ndarray
    width: int

    def times(self, weights: np.ndarray) -> np.ndarray:
        """The matrix times ``weights``, read off running sums."""
        sums = np.concatenate([[0.0], np.cumsum(weights[self.places])])
        return sums[self.ends[1:]] - sums[self.ends[:-1]]

    def across(self, values: np.ndarray) -> np.ndarray:
        """The transposed matrix times a column of ``values``."""
        return np.bincount(self.places, np.repeat(values, np.diff(self.ends)), self.width)


def _newton(design: _Design, grades: np.ndarray, top: int, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Penalised maximum likelihood. Each of the ``top`` thresholds asks whether a grade exceeds it; the
    answers share the weights, and the sum of their logistic losses is convex, so damped Newton steps
    find its minimum. The curvature is never written out: conjugate gradients need only its product with
    a vector, two passes over the ones of the matrix."""
    count, width = len(grades), design.width
    above = np.stack([grades > j for j in range(top)], axis=1).astype(np.float64)
    share = np.clip(above.mean(axis=0), 1e-4, 1 - 1e-4)
    found = np.concatenate([np.zeros(width), -np.log(share / (1 - share))])
    ridge = np.concatenate([np.full(width, RIDGE), np.full(top, RIDGE / 100)])

    def margins(values: np.ndarray) -> np.ndarray:
        return design.times(values[:width])[:, None] - values[None, width:]

    def gathered(values: np.ndarray) -> np.ndarray:
        return np.concatenate([design.across(values.sum(axis=1)), -values.sum(axis=0)])

    def loss(values: np.ndarray) -> float:
        z = margins(values)
        return float(np.logaddexp(0, z).sum() - (above * z).sum() + (ridge * values * values).sum() / 2)

    now = loss(found)
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-margins(found)))
        curve = chance * (1 - chance)
        slope = gathered(chance - above) + ridge * found
        scales = ridge + np.concatenate([design.across(curve.sum(axis=1)), curve.sum(axis=0)])
        step = _solve(lambda v, curve=curve: gathered(curve * margins(v)) + ridge * v, slope, scales)
        scale = 1.0
        while scale > 1e-6 and (then := loss(found - scale * step)) > now:
            scale /= 2
        if scale <= 1e-6:
            break
        found = found - scale * step
        if now - then < 1e-6 * count:
            break
        now = then
    return found[:width], np.maximum.accumulate(found[width:])


def _solve(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Conjugate gradients with the diagonal ``scales`` as the preconditioner, until about a
    thirtieth of ``right`` is left; the next Newton step takes up the rest."""
    out, rest = np.zeros_like(right), right.copy()
    way = ahead = rest / scales
    size = first = rest @ ahead
    for _ in range(INNER_STEPS):
        if size <= 1e-3 * first or size == 0:
            break
        moved = product(way)
        length = size / (way @ moved)
        out, rest = out + length * way, rest - length * moved
        ahead = rest / scales
        size, before = rest @ ahead, size
        way = ahead + size / before * way
    return out


def score_severity(docs: DataFrame, model: OrdinalModel, text: str = "text", out: str = "severity") -> DataFrame:
    """``docs`` with ``out``, the expected grade of the whole text. Null texts give null; a text without a
    known word is judged by the thresholds alone. A clashing ``out`` gets underscores. No row moves; the
    model (at most :data:`FEATURES` words) goes to the tasks."""
    out = free_name(docs.columns, out)
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        fitted = OrdinalModel(**shared.value)
        weight = dict(zip(fitted.words, fitted.weights.tolist(), strict=True))
        words, known = regex.compile(r"\p{L}+").findall, set(fitted.words)
        for whole in batches:
            for batch in text_slices(whole, at):
                texts = batch.column(at).to_pylist()
                score = np.array([sum(map(weight.__getitem__, known.intersection(words((t or "").lower())))) for t in texts], dtype=np.float64)
                severity = fitted.expected(score).tolist()
                column = pa.array([None if t is None else s for t, s in zip(texts, severity, strict=True)], pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return docs.mapInArrow(add, StructType([*docs.schema.fields]).add(out, "double"))
