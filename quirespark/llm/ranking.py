"""Quality scores by Bradley-Terry pairwise ranking.

Documents are described by the form of the whole text. From
labelled documents, preference pairs (a good one over a poor one) are drawn and
a linear score is learned by logistic loss on the feature differences; the
decision is a threshold at a quantile of the scores.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window

from quirespark.llm.common import held_out, small_batches, training_labels, written


WIDTH = 12
_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'-"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def describe(text: str | None) -> list[float]:
    """A text's form in ``WIDTH`` numbers, from its bytes' histogram, its words and a few pairs of marks."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, chars = len(words) or 1, len(text) + 1
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)

    def share(x: float, of: float, half: float) -> float:
        """Grows from 0 to 1, 0.5 where the share is ``half``: a few marks already tell."""
        s = float(x) / of
        return s / (s + half)

    pairs = sum(data.count(p) for p in (b"**", b"$$", b"%%", b"&&", b"##", b"@@", b"~~", b"=="))
    return [
        share(seen[_UPPER].sum(), chars, 0.1),
        share(data.count(b"!!"), n, 0.05),
        share(seen[124], n, 0.05),
        share(pairs, n, 0.05),
        share(sum(map(eq, words, islice(words, 1, None))), n, 0.05),
        len(set(words)) / n,
        math.log1p(len(words)) / 10,
        share(seen[48:58].sum(), chars, 0.05),
        share(seen[_MARKS].sum(), chars, 0.05),
        share(seen[33] + seen[46] + seen[63], n, 0.1),
        chars / n / 20,
        share(seen[10], n, 0.05),
    ]


@F.arrow_udf(ArrayType(DoubleType()))
def features(text: pa.Array) -> pa.Array:
    """Of each whole text; null and empty texts give fixed values."""
    flat = np.array([describe(t) for t in text.to_pylist()], np.float64).reshape(-1, WIDTH)
    return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, WIDTH, dtype=np.int32), flat.ravel())


@dataclass(frozen=True)
class Ranking:
    """A linear score, the score quantile that divides good from poor, and its scale."""

    weights: tuple[float, ...]
    threshold: float
    scale: float
    quantile: float

    def raw(self, x: Column) -> Column:
        return F.aggregate(F.zip_with(x, F.array(*map(F.lit, self.weights)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def score(self, x: Column, at_threshold: float = 0.3) -> Column:
        """0 to 1, ``at_threshold`` at the threshold."""
        z = (self.raw(x) - F.lit(self.threshold)) / F.lit(self.scale) + F.lit(float(np.log(at_threshold / (1 - at_threshold))))
        return 1 / (1 + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 12_000, pairs: int = 4, id_col: str = "doc_id", text_col: str = "text") -> Ranking:
    """Learns from at most ``most`` labelled rows outside the test fold.

    Each good document is compared with ``pairs`` poor ones, dealt in turn in
    hash order. Without both labels all weights are 0. The threshold is the
    quantile of scores with the best balanced accuracy on the sample, halfway
    between its neighbours where several are equal.
    """
    small_batches(docs.sparkSession)
    chosen = training_labels(labels, label, most, id_col)
    sample = written(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "id")  # at most ``most`` rows
        .select("id", "label", features(F.col("text")).alias("x")),
        "quality",
    )
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")  # of a bounded sample
    ranked = sample.withColumn("at", F.row_number().over(order) - 1)
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, poor = counts.get(1, 0), counts.get(0, 0)
    if not good or not poor:
        return Ranking((0.0,) * WIDTH, 0.0, 1.0, 0.0)
    winners = ranked.where("label = 1").select("x", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))).alias("k"), "at")
    winners = winners.select("x", F.pmod(F.col("at") * pairs + F.col("k"), F.lit(poor)).alias("rival"), F.pmod(F.col("at") + F.col("k"), F.lit(2)).alias("side"))
    losers = ranked.where("label = 0").select(F.col("at").alias("rival"), F.col("x").alias("y"))
    # half of the differences are turned round, as the loss asks for both outcomes
    sign = F.when(F.col("side") == 1, 1.0).otherwise(-1.0)
    diff = winners.join(losers, "rival").select(
        F.col("side").cast("double").alias("label"), array_to_vector(F.zip_with("x", "y", lambda a, b: (a - b) * sign)).alias("features")
    )
    model = LogisticRegression(fitIntercept=False, standardization=True, regParam=1e-3, maxIter=60).fit(written(diff, "pairs"))
    weights = tuple(float(w) for w in model.coefficients)
    levels = np.linspace(0, 1, 401)
    raw = Ranking(weights, 0.0, 1.0, 0.0).raw(F.col("x"))
    by = {
        r["label"]: np.array(r["q"])
        for r in sample.select("label", raw.alias("s")).groupBy("label").agg(F.percentile("s", F.array(*(F.lit(float(q)) for q in levels))).alias("q")).collect()
    }
    everything = np.sort(np.concatenate([by[0], by[1]]))
    middle = (everything[1:] + everything[:-1]) / 2
    accuracy = np.searchsorted(by[0], middle, side="left") + (len(levels) - np.searchsorted(by[1], middle, side="left"))
    best = middle[accuracy == accuracy.max()]
    threshold = float((best[0] + best[-1]) / 2)
    below = sample.agg(F.avg((raw < threshold).cast("double"))).first()[0]
    # a slope at which the classes' middles are some units from the threshold
    scale = max(1e-6, float(np.median(by[1]) - np.median(by[0])) / 12)
    return Ranking(weights, threshold, scale, float(below))


def score_quality(docs: DataFrame, model: Ranking, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with held_out, score and predicted, their names after ``prefix``; columns of these names are replaced.

    Null texts score as empty ones; all rows and the other columns are kept.
    """
    small_batches(docs.sparkSession)
    own = f"_features_{uuid.uuid4().hex}"  # clashes with no column
    described = docs.withColumn(own, features(F.col(text_col)))
    scored = described.withColumn(f"{prefix}score", model.score(F.col(own), cut)).drop(own)
    return scored.withColumns({f"{prefix}held_out": held_out(F.col(id_col)), f"{prefix}predicted": (F.col(f"{prefix}score") >= cut).cast("int")})
