"""Toxic spans by a linear-chain conditional random field.

Labels are per document, so a toxic document's tokens are labelled from it: words
and word beginnings that are far more frequent in documents marked toxic, and what
stands between two of them. A chain over two states (clean, toxic) is fitted to
labelled sentences by its exact log-likelihood; its features are those words, words
as typical of clean documents, and the shape of the others (shouted or not). In a document, forward-backward
marginals of the tokens give the offending offsets and, over the document, its
score. Tokens outside the field's vocabulary all have the same potential, so a
run of them is one power of a 2 x 2 matrix: the marginals stay exact and cost
what the vocabulary's tokens cost.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import held_out, small_batches, training_labels, written

_WORD = re.compile(r"\w+")
_CAPITALS = re.compile("[A-ZÀ-ÖØ-ÞĀ-ɏΑ-ΫА-Я]{4}")
_SENTENCE = re.compile(r"[^.!?\n]+")
#: Lengths of the word beginnings that are features beside the whole word.
BEGINNINGS = (8, 7, 6, 5, 4, 3)


#: The feature of a shouted word that has none of its own, and tokens between two toxic ones that are labelled with them.
SHOUTED, BETWEEN = "^", 2


def tokens_of(text: str) -> list[str]:
    """The words of a text, with lower-case letters unless shouted: four or more letters, all of them capitals."""
    low = text.lower()
    if len(low) == len(text) and not _CAPITALS.search(text):  # most texts
        return _WORD.findall(low)
    return [w if len(w) > 3 and w.isupper() and w.isalpha() else w.lower() for w in _WORD.findall(text)]


class Features(dict):
    """Each word's feature: itself (ending in $) or else its longest beginning that is known, else its shape; 0 for none. A bounded cache."""

    def __init__(self, known: dict[str, int], most: int = 400_000):
        super().__init__()
        self.known, self.most = known, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        known, low = self.known, word.lower()
        got = known.get(low + "$", 0) or next((i for n in BEGINNINGS if (i := known.get(low[:n], 0))), 0)
        if not got and low != word:
            got = known.get(SHOUTED, 0)
        self[word] = got
        return got


def _sums(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(z - top).sum(axis=axis))


def gradient(theta: np.ndarray, tokens: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the tags and its gradient: counts seen less counts expected by forward-backward.

    ``theta`` is the toxic state's weight of each vocabulary entry, then the log
    transitions clean to toxic, toxic to clean, toxic to toxic (clean to clean is 0).
    Sentences are rows padded at the right.
    """
    n, most = tokens.shape
    size = len(theta) - 3
    mask = np.arange(most) < lengths[:, None]
    pairs = mask[:, 1:]
    seen = np.bincount(tokens[mask & (tags == 1)], minlength=size).astype(float)
    seen_t = np.array([(pairs & (tags[:, :-1] == a) & (tags[:, 1:] == b)).sum() for a, b in ((0, 1), (1, 0), (1, 1))], float)
    w, t = theta[:size], np.array([[0, theta[size]], [theta[size + 1], theta[size + 2]]])
    emit = np.stack([np.zeros(tokens.shape), w[tokens]], axis=2)
    alpha = np.zeros((n, most, 2))
    alpha[:, 0] = emit[:, 0]
    for i in range(1, most):
        new = _sums(alpha[:, i - 1, :, None] + t[None], 1) + emit[:, i]
        alpha[:, i] = np.where(mask[:, i, None], new, alpha[:, i - 1])
    z = _sums(alpha[:, -1], 1)
    beta = np.zeros((n, most, 2))
    trans = np.zeros((2, 2))
    for i in range(most - 2, -1, -1):
        ahead = t[None] + (emit[:, i + 1] + beta[:, i + 1])[:, None, :]
        inside = mask[:, i + 1]
        beta[:, i] = np.where(inside[:, None], _sums(ahead, 2), beta[:, i + 1])
        joint = np.exp(alpha[:, i, :, None] + ahead - z[:, None, None])
        trans += joint[inside].sum(axis=0)
    toxic = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * mask
    expected = np.bincount(tokens[mask], weights=toxic[mask], minlength=size)
    likelihood = float(seen @ w + seen_t @ theta[size:] - z.sum())
    return likelihood, np.r_[seen - expected, seen_t - np.array([trans[0, 1], trans[1, 0], trans[1, 1]])]


def fit_chain(tokens: np.ndarray, tags: np.ndarray, lengths: np.ndarray, size: int, steps: int = 80, decay: float = 1.0):
    """Weights (size) of the toxic state for each vocabulary entry and log transitions (2 x 2), by gradient ascent (Adam) with an L2 penalty."""
    theta = np.zeros(size + 3)
    theta[0] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = gradient(theta, tokens, tags, lengths)[1] - decay * theta * 0.1
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:size], np.array([[0, theta[size]], [theta[size + 1], theta[size + 2]]])


@dataclass
class Chain:
    """Vocabulary (feature to number), each number's weight of the toxic state (0: all other words), transitions, calibration."""

    known: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    calibration: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self):
        self.other = float(self.weights[0])
        self.feature = Features(self.known)
        self.step = np.exp(self.transitions)
        self.powers = {0: np.eye(2)}
        self.steps = {}

    def gap(self, n: int) -> np.ndarray:
        """Potential of ``n`` words outside the vocabulary, scaled to a largest entry of 1."""
        if n not in self.powers:
            if n == 1:
                got = self.step * np.array([1.0, np.exp(self.other)])
            else:
                half = self.gap(n // 2)
                got = half @ half @ self.gap(n % 2)
            got = got / got.max()
            if n > 4096 and n.bit_count() > 1:
                return got
            self.powers[n] = got
        return self.powers[n]

    def between(self, n: int) -> tuple[float, float, float, float]:
        """From a vocabulary's token over ``n`` others into the next one, as plain numbers row by row."""
        got = self.steps.get(n)
        if got is None:
            got = tuple((self.gap(n) @ self.step).ravel().tolist())
            if len(self.steps) < 100_000:
                self.steps[n] = got
        return got

    def marginals(self, places: list[int], weights: list[float], n: int) -> list[float]:
        """P(toxic) of the vocabulary's tokens at ``places`` among ``n`` tokens; plain numbers, as the matrices are 2 x 2."""
        emit = [math.exp(w) for w in weights]
        if places[0]:
            x, y = (np.array([1.0, math.exp(self.other)]) @ self.gap(places[0] - 1) @ self.step).tolist()
        else:
            x = y = 1.0  # the first token has no transition into it
        forward = []
        for i, e in enumerate(emit):
            if i:
                p, q, r, s = self.between(places[i] - places[i - 1] - 1)
                x, y = x * p + y * r, x * q + y * s
            y *= e
            total = x + y
            x, y = x / total, y / total
            forward.append((x, y))
        u, v = (self.gap(n - 1 - places[-1]) @ np.ones(2)).tolist()
        out = [0.0] * len(places)
        for i in range(len(places) - 1, -1, -1):
            x, y = forward[i]
            out[i] = y * v / (x * u + y * v)
            if i:
                p, q, r, s = self.between(places[i] - places[i - 1] - 1)
                v *= emit[i]
                u, v = p * u + q * v, r * u + s * v
                most = max(u, v)
                u, v = u / most, v / most
        return out

    def tag(self, text: str | None, at: float = 0.5) -> tuple[float, float, list[tuple[int, int]]]:
        """(largest marginal, expected toxic tokens, spans of marginals of ``at`` or more) over the vocabulary's tokens."""
        found = list(map(self.feature.__getitem__, tokens_of(text or "")))
        places = [i for i, f in enumerate(found) if f] if any(found) else []
        if not places:
            return 0.0, 0.0, []
        p = self.marginals(places, [self.weights[found[i]] for i in places], len(found))
        hot = {i for i, x in zip(places, p, strict=True) if x >= at}
        spans = [m.span() for i, m in enumerate(_WORD.finditer(text)) if i in hot] if hot else []
        return max(p), sum(p), spans

    def score(self, top: float, total: float) -> float:
        a, b, c = self.calibration
        return float(1 / (1 + np.exp(-(a + b * top + c * np.log1p(total)))))


def tags_of(toxic: np.ndarray) -> np.ndarray:
    """Toxic tokens of each row, and up to ``BETWEEN`` tokens between two of them."""
    tags = toxic.copy()
    for gap in range(1, BETWEEN + 1):
        both = toxic[:, : -gap - 1] & toxic[:, gap + 1 :]
        for k in range(1, gap + 1):
            tags[:, k : k + both.shape[1]] |= both
    return tags.astype(int)


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-2) -> np.ndarray:
    """Newton's method on the penalised logistic loss, with an intercept first."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - decay * w)
    return w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    most: int = 8_000,
    most_sentences: int = 6_000,
    longest: int = 64,
    min_share: float = 0.005,
    min_odds: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Chain:
    """Learns from at most ``most`` labelled rows outside the test fold.

    The vocabulary is every word or beginning in at least ``min_share`` of the toxic
    texts (4 at least) whose log odds against clean ones are ``min_odds`` or more,
    and those in as large a share of the clean ones whose odds are as low; equal
    texts count once, as toxic if any is. The sample bounds it. The chain is fitted to at most ``most_sentences`` sentences of
    ``longest`` tokens, first those with a word of the vocabulary, in hash order.
    Without both labels the vocabulary is empty and every score is the same.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = training_labels(labels, label, most, id_col)
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")  # at most ``most`` ids
    # of rows that repeat an id one text counts, of equal texts the toxic label
    once = known.groupBy("id", "label").agg(F.min("text").alias("text"))
    sample = written(once.groupBy("text").agg(F.min("id").alias("id"), F.max("label").alias("label")), "toxic")
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Chain({}, np.zeros(1), np.zeros((2, 2)), (float(np.log((n.get(1, 0) + 0.5) / (n.get(0, 0) + 0.5))), 0.0, 0.0))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))
    parts = F.transform(words, lambda w: F.array(F.concat(w, F.lit("$")), *(F.substring(w, 1, n) for n in BEGINNINGS)))
    words = sample.select("label", F.explode(F.array_distinct(F.flatten(parts))).alias("word"))
    odds = words.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("c"))
    often = (F.col("t") >= max(4, min_share * n[1])) | (F.col("c") >= max(4, min_share * n[0]))
    odds = odds.where(often).withColumn("odds", F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1)))
    strong = odds.where((F.col("odds") >= min_odds) & (F.col("t") >= max(4, min_share * n[1])) | (F.col("odds") <= -min_odds))
    lexicon = [(r["word"], r["odds"] > 0) for r in strong.orderBy(F.desc("odds"), "word").collect()]  # words of a bounded sample
    place = {w: i + 1 for i, (w, _) in enumerate(lexicon)} | {SHOUTED: len(lexicon) + 1}  # 0: any other word
    marks = np.array([False, *(toxic for _, toxic in lexicon), False])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature = Features(place)
        for batch in batches:
            rows = []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s in _SENTENCE.findall(text):
                    ids = [feature[w] for w in tokens_of(s)]
                    rows += [(y, part) for k in range(0, len(ids), longest) if (part := ids[k : k + longest])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["label", "ids"]
            )

    coded = sample.select("label", "text").mapInArrow(encode, "label int, ids array<int>")
    known = F.exists("ids", lambda i: i > 0)
    taken = coded.orderBy(known.desc(), F.xxhash64("ids", "label")).limit(most_sentences).collect()
    tokens = np.zeros((len(taken), longest), np.int64)
    lengths = np.array([len(r["ids"]) for r in taken])
    for i, r in enumerate(taken):
        tokens[i, : lengths[i]] = r["ids"]
    tags = tags_of(marks[tokens] & (np.array([r["label"] for r in taken]) == 1)[:, None])
    weights, transitions = fit_chain(tokens, tags, lengths, len(place) + 1)
    chain = Chain(place, weights, transitions)
    got = tagged(sample, chain, "id", "text").select("label", "top", "total").collect()  # at most ``most`` rows of numbers
    x = np.array([[r["top"], np.log1p(r["total"])] for r in got])
    fitted = _logistic(x, np.array([float(r["label"]) for r in got]))
    chain.calibration = tuple(float(f) for f in fitted)
    return chain


def tagged(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """``docs``' id (and label, if there is one) with top, total, score (and spans of character offsets).

    Whole texts; null and empty ones have no tokens and get the score of a text
    without evidence.
    """
    small_batches(docs.sparkSession)
    more = [c for c in ("label",) if c in docs.columns]
    known, weights, transitions, calibration = chain.known, chain.weights, chain.transitions, chain.calibration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(known, weights, transitions, calibration)
        for batch in batches:
            got = [model.tag(t) for t in batch.column("text").to_pylist()]
            cols = [batch.column(c) for c in ["id", *more]]
            cols += [
                pa.array([g[0] for g in got], pa.float64()),
                pa.array([g[1] for g in got], pa.float64()),
                pa.array([model.score(g[0], g[1]) for g in got], pa.float64()),
            ]
            names = ["id", *more, "top", "total", "score"]
            if with_spans:
                cols.append(pa.array([[list(s) for s in g[2]] for g in got], pa.list_(pa.list_(pa.int32()))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "id long, " + "".join(f"{c} int, " for c in more) + "top double, total double, score double" + (", spans array<array<int>>" if with_spans else "")
    return docs.select(F.col(id_col).cast("long").alias("id"), *more, F.col(text_col).alias("text")).mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, chain: Chain, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """(id, held_out, score, predicted, spans) for each row."""
    got = tagged(docs, chain, id_col, text_col, with_spans)
    return got.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
        *(["spans"] if with_spans else []),
    )
