"""Toxicity as severity grades: cumulative-link (proportional odds) regression on sparse text features.

With one weight vector w and ordered thresholds t1 < t2 < ..., P(grade >= k | x) = sigmoid(w.x - tk). Written out, every
labelled text becomes one binary row per threshold, with the text's features, the threshold's own indicator and the
answer to "is the grade at least k"; logistic regression over these rows shares the weights across the thresholds and
fits both together. Expected severity is the sum of the threshold probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import seeded, small_batches, stage

LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
#: Labelled rows that are fitted on at most; a seeded share of them is taken when there are more.
MAX_ROWS = 40_000
#: Features that enter the model at most, those of the strongest association first.
MAX_FEATURES = 20_000


def features_of(text: str | None) -> Counter:
    """Words and word beginnings of a text (``"loser"``, ``"lose*"``) with their counts."""
    counts = Counter(LETTERS.findall((text or "").lower()))
    found = Counter(counts)
    for word, n in counts.items():
        for size in STEMS:
            if len(word) >= size:
                found[word[:size] + "*"] += n
    return found


@dataclass(frozen=True)
class Severity:
    """Fitted weights: log1p of a feature's count times its weight, and one threshold per grade above zero."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        weights, out = self.weights, np.zeros(len(texts))
        words = {f for f in weights if not f.endswith("*")}
        stems = {size: {f[:-1]: w for f, w in weights.items() if f.endswith("*") and len(f) == size + 1} for size in STEMS}
        for i, text in enumerate(texts):
            if not text:
                continue
            held: dict[str, int] = {}
            for word, n in Counter(LETTERS.findall(text.lower())).items():
                if word in words:
                    held[word] = held.get(word, 0) + n
                for size, known in stems.items():
                    stem = word[:size]
                    if stem in known and len(stem) == size:
                        held[stem + "*"] = held.get(stem + "*", 0) + n
            out[i] = sum(weights[f] * np.log1p(n) for f, n in held.items())
        return out

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; a null or empty text is decided by the thresholds alone."""
        logit = self.scores(texts)[:, None] - np.array(self.thresholds)[None, :]
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60)))


def _counted(sample: DataFrame, where: str, only: frozenset[str] | None = None) -> DataFrame:
    """Texts with a feature among those that satisfy ``where``; counted within each task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Counter()
        for batch in batches:
            for text in batch["text"]:
                found = features_of(text).keys()
                seen.update(found if only is None else only.intersection(found))
        yield pd.DataFrame({"feature": list(seen), "n": list(seen.values())}).astype({"feature": object, "n": "int64"})

    return sample.where(where).mapInPandas(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def fit_severity(
    sample: DataFrame, grades: int = 3, severe_hits: int | None = 16, max_features: int = MAX_FEATURES, least: int = 4,
    lift: float = 6.0, penalty: float = 3e-6,
) -> Severity:
    """Fit on bounded rows of ``text, grade`` (0 .. grades - 1), see :func:`training_rows`; null texts or grades teach nothing.

    Features are those seen in ``least`` graded texts or more and ``lift`` times as often there as in clean ones. Where
    labels only say yes or no (grade 1), ``severe_hits`` occurrences of such features or more (a long word counts with its beginnings) make grade 2; data with real
    grades passes None. Without rows above or at grade 0, or without any feature, the model calls nothing toxic.
    """
    small_batches(sample.sparkSession)
    sample = stage(sample.select("text", F.col("grade").cast("int").alias("grade")).where(
        f"text IS NOT NULL AND grade BETWEEN 0 AND {grades - 1}"
    ), "labelled")
    sizes = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    above = sum(n for g, n in sizes.items() if g > 0)
    nothing = Severity({}, tuple(20.0 + k for k in range(1, grades)))
    if not above or not sizes.get(0):
        return nothing
    # What comes back is bounded by the bounded sample.
    bad = {r["feature"]: r["n"] for r in _counted(sample, "grade > 0").where(F.col("n") >= least).collect()}
    good = {r["feature"]: r["n"] for r in _counted(sample, "grade = 0", frozenset(bad)).collect()}
    rate = {f: ((n + 0.5) / (above + 1.0)) / ((good.get(f, 0) + 0.5) / (sizes[0] + 1.0)) for f, n in bad.items()}
    names = sorted((f for f, r in rate.items() if r >= lift), key=lambda f: (-rate[f], f))[:max_features]
    if not names:
        return nothing
    place = {f: i for i, f in enumerate(names)}
    size = len(names) + grades - 1

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, grade in zip(batch["text"], batch["grade"]):
                held = {f: n for f, n in features_of(text).items() if f in place}
                pairs = {place[f]: float(np.log1p(n)) for f, n in held.items()}
                if severe_hits and grade == 1 and sum(held.values()) >= severe_hits:
                    grade = 2
                for k in range(1, grades):
                    full = sorted({**pairs, len(names) + k - 1: 1.0}.items())
                    out.append((float(grade >= k), [i for i, _ in full], [v for _, v in full]))
            yield pd.DataFrame(out, columns=["label", "at", "value"])

    @F.udf(VectorUDT())
    def vector(at, value):
        return Vectors.sparse(size, at, value)

    binary = sample.mapInPandas(expand, "label double, at array<int>, value array<double>")
    # Many texts have the same few features: equal rows become one row with a weight.
    grouped = stage(binary.groupBy("label", "at", "value").agg(F.count(F.lit(1)).cast("double").alias("weight")), "binary")
    model = LogisticRegression(
        regParam=penalty, maxIter=100, fitIntercept=False, standardization=False, weightCol="weight",
    ).fit(grouped.select("label", "weight", vector("at", "value").alias("features")).coalesce(8))
    fitted = model.coefficients.toArray()
    thresholds = np.maximum.accumulate(-fitted[len(names):])
    return Severity({f: float(fitted[i]) for f, i in place.items() if abs(fitted[i]) > 1e-6}, tuple(float(t) for t in thresholds))


def severity_column(model: Severity):
    """Pandas UDF of a text: ``struct(p1, severity)``, the chance of any toxicity and the expected grade."""

    @F.pandas_udf("p_toxic double, severity double")
    def score(texts: pd.Series) -> pd.DataFrame:
        p = model.probabilities([None if t is None else t for t in texts])
        return pd.DataFrame({"p_toxic": p[:, 0], "severity": p.sum(axis=1)})

    return score


def grade_documents(docs: DataFrame, model: Severity, reject_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, p_toxic, severity, grade, rejected`` per row; null and empty texts get the base severity and are kept.

    Whole texts are read whatever their length; repeated rows are scored alike; columns of other names play no part.
    """
    small_batches(docs.sparkSession)
    scored = docs.select(F.col(id_col).alias("doc_id"), severity_column(model)(F.col(text_col)).alias("_s"))
    return scored.select(
        "doc_id", F.col("_s.p_toxic").alias("p_toxic"), F.col("_s.severity").alias("severity"),
        F.round("_s.severity").cast("int").alias("grade"), (F.col("_s.severity") >= reject_at).alias("rejected"),
    )


def drop_toxic(docs: DataFrame, model: Severity, reject_at: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` under the severity, with all their columns as they are."""
    small_batches(docs.sparkSession)
    return docs.where(severity_column(model)(F.col(text_col))["severity"] < reject_at)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seed: int = 7) -> DataFrame:
    """``text, grade`` of about ``max_rows`` labelled documents (all, if there are fewer), chosen by a seeded hash of the id.

    A document with several labels has the more severe one; labels without id or value are left out. The chosen labels
    are broadcast: ``max_rows`` bounds them whatever the size of the tables, and texts are not shuffled.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_label_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("grade")
    )
    part = min(1.0, max_rows / max(1, known.count()))
    chosen = known.where(seeded(seed, F.col("_label_id")) < part)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_label_id")).select("text", "grade")
