"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 .. K - 1 share one weight per hashed feature; ordered thresholds t1 < t2 < ... turn a text's score s into
P(grade >= g) = sigmoid(s - t_g), and their sum is the expected grade. Features are hashed from the whole text:
its distinct lower-case words, and marks of its writing (shouting, words that are mostly signs, a word that follows
itself, lines or windows that return, mean word length), both scaled to a fixed length; features of fewer than LEAST_SHARE
of the sample are left out, so that single documents are not learned by heart. The fit is proportional-odds
maximum likelihood with a ridge penalty by full-batch Adam over at most ``per_grade`` labelled rows of every grade,
taken in hash order; that sample's hashed features are all that reaches the driver. Scoring is one pass without a
shuffle.

Cases: a null or blank text has no features and gets the grade probabilities of the thresholds alone; labels of ids
that have no document, and null labels, are ignored; contradicting labels of an id count as the lowest; of
rows that repeat a labelled id one is learned from, always the same; a grade without labels is passed over (its threshold is not
moved by data); with labels of fewer than two grades ``fit`` raises ValueError and ``fit_with_cutoff`` selects nothing; rows that repeat are scored alike;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

BITS = 18
PER_GRADE = 2500
MARK_SCALE = 3.0  # marks against words, which are many
KEEP_GOOD = 0.99
LEAST_SHARE = 0.004  # of the sample, for a feature to count
CACHE_WORDS = 300_000
SIGNS = frozenset("#*$%&|<>!?{}[]()=+~^_\\/@;:")


def _mark(name: str, share: float) -> list[str]:
    """A mark in steps: every step reached is a feature, so weights add up along the scale."""
    return [f"\x00{name}{i}" for i, bound in enumerate((0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)) if share > bound]


class Features:
    """Indexes and values of a text's hashed features."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def index(self, names) -> list[int]:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in names:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w) >> (64 - BITS)
        return [known[w] for w in names]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        raw = text.split()
        if not raw:
            return np.zeros(0, np.int64), np.zeros(0)
        n = len(raw)
        words = set(text.lower().split())
        lines = [x for x in text.split("\n") if x.strip()]
        signs = sum(map(text.count, SIGNS))
        triples = set(zip(raw, raw[1:], raw[2:], strict=False))
        length = sum(map(len, raw))
        upper = sum(map(str.isupper, raw)) / n
        marks = [*_mark("upper", upper), *_mark("signs", signs / length),
                 *_mark("again", sum(a == b for a, b in zip(raw, raw[1:], strict=False)) / n),
                 *_mark("lines", 1 - len(set(lines)) / max(1, len(lines))),
                 *_mark("windows", 1 - len(triples) / max(1, n - 2) if n > 2 else 0.0),
                 f"\x00long{min(12, round(length / n))}", f"\x00size{min(16, n.bit_length())}"]
        a, b = self.index(words), self.index(marks)
        at = np.array(a + b, np.int64)
        values = np.concatenate([np.full(len(a), 1 / np.sqrt(max(1, len(a)))), np.full(len(b), MARK_SCALE / np.sqrt(len(b)))])
        return at, values


@dataclass
class Model:
    weights: np.ndarray  # one per hashed feature
    thresholds: np.ndarray  # increasing, one per grade above 0

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1 .. K - 1, a column each."""
        return 1 / (1 + np.exp(-(scores[:, None] - self.thresholds[None, :])))


def fit_sample(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               per_grade: int = PER_GRADE) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(grade, indexes, values) of at most ``per_grade`` documents of every grade. ratings: (id, grade).

    The picked ids, at most ``per_grade`` times the number of grades, are broadcast to the documents.
    """
    graded = ratings.filter("grade IS NOT NULL").groupBy(col(id_col).alias("id")).agg(F.min("grade").alias("grade"))
    grades = [r["grade"] for r in graded.select("grade").distinct().orderBy("grade").collect()]
    picked = None
    for g in grades:
        some = graded.filter(F.col("grade") == g).orderBy(F.xxhash64("id"), "id").limit(per_grade)
        picked = some if picked is None else picked.union(some)
    if picked is None:
        return []

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in batches:
            made = [make(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("grade"), batch.column("id"), pa.array([m[0] for m in made], pa.list_(pa.int64())),
                pa.array([m[1] for m in made], pa.list_(pa.float64()))], ["grade", "id", "at", "v"])

    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(picked), "id").select(
        F.col("grade").cast("int"), F.col("id").cast("long"), "text").mapInArrow(features, "grade int, id long, at array<long>, v array<double>")
    # of the rows of an id the one whose features come first by hash, whatever order they come in
    rows = rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("at", "v").alias("h"), "grade", "at", "v")).alias("r")).select("r.*", "id").orderBy("id")
    return [(r["grade"], np.array(r["at"], np.int64), np.array(r["v"])) for r in rows.toLocalIterator()]


def fit(sample: list[tuple[int, np.ndarray, np.ndarray]], n_grades: int, ridge: float = 5e-6, steps: int = 250,
        rate: float = 0.15, least_share: float = LEAST_SHARE) -> Model:
    """Maximum likelihood; every grade weighs the same in sum, however rare it is."""
    grade = np.array([s[0] for s in sample])
    if len(set(grade.tolist())) < 2:
        raise ValueError("labelled rows of at least two grades are needed")
    at = np.concatenate([s[1] for s in sample])
    v = np.concatenate([s[2] for s in sample])
    row = np.repeat(np.arange(len(sample)), [len(s[1]) for s in sample])
    common = (np.bincount(at, minlength=1 << BITS) >= least_share * len(sample))[at]
    at, v, row = at[common], v[common], row[common]
    used, at = np.unique(at, return_inverse=True)
    share = 1 / np.bincount(grade, minlength=n_grades)[grade]
    share /= share.sum()
    # thresholds: the first and logs of the gaps, so that they stay ordered
    w, t = np.zeros(len(used)), np.zeros(n_grades - 1)
    m, s = np.zeros(len(used) + len(t)), np.zeros(len(used) + len(t))
    for step in range(1, steps + 1):
        gaps = np.concatenate([t[:1], np.exp(t[1:])])
        bounds = np.cumsum(gaps)
        score = np.bincount(row, w[at] * v, len(sample))
        tail = 1 / (1 + np.exp(-(score[:, None] - bounds)))
        # P(grade) = tail_g - tail_{g+1}; d log P / d(score - bound)
        full = np.concatenate([np.ones((len(sample), 1)), tail, np.zeros((len(sample), 1))], axis=1)
        p = np.maximum(full[np.arange(len(sample)), grade] - full[np.arange(len(sample)), grade + 1], 1e-12)
        slope = full * (1 - full)
        low, high = slope[np.arange(len(sample)), grade] / p, slope[np.arange(len(sample)), grade + 1] / p
        g_score = (low - high) * share
        g_bounds = np.zeros(n_grades + 1)
        np.add.at(g_bounds, grade, -low * share)
        np.add.at(g_bounds, grade + 1, high * share)
        g_bounds = g_bounds[1:-1]
        g_t = np.cumsum(g_bounds[::-1])[::-1] * np.concatenate([[1.0], gaps[1:]])
        g_w = np.bincount(at, v * g_score[row], len(used)) - ridge * w
        g = np.concatenate([g_w, g_t])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8) * min(1, 2 * (1 - step / (steps + 1)))
        w, t = w + move[:len(used)], t + move[len(used):]
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])))


def fit_with_cutoff(sample: list[tuple[int, np.ndarray, np.ndarray]], n_grades: int, select_grade: int | None = None,
                    keep: float = KEEP_GOOD, least_share: float = LEAST_SHARE) -> tuple[Model, float]:
    """A model of three quarters of the sample, and the tail probability that ``keep`` of the grade's rest reach.

    Where those have fewer than two grades there is nothing to learn: all texts get the lowest grade, none is selected.
    """
    grade = n_grades - 1 if select_grade is None else select_grade
    learned = [x for i, x in enumerate(sample) if i % 4]
    if len({x[0] for x in learned}) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 50.0 + np.arange(n_grades - 1)), 0.5
    model = fit(learned, n_grades, least_share=least_share)
    rest = [x for i, x in enumerate(sample) if i % 4 == 0 and x[0] >= grade]
    if not rest:
        return model, 0.5
    tails = model.tails(np.array([model.weights[at] @ v for _, at, v in rest]))[:, grade - 1]
    return model, float(min(0.5, np.quantile(tails, 1 - keep)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", select_grade: int | None = None,
          select_tail: float = 0.5) -> DataFrame:
    """Per document: id, score, expected_grade, tails (P(grade >= 1), ...), selected: tail of a grade high enough."""
    table = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights
    grade = len(model.thresholds) if select_grade is None else select_grade

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, m = Features(), table.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column("text").to_pylist()):
                at, v = make(text)
                scores[i] = m.weights[at] @ v if len(at) else 0.0
            tails = m.tails(scores)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(scores), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64())),
                pa.array(tails[:, grade - 1] >= select_tail)], [batch.schema.names[0], "score", "expected_grade", "tails", "selected"])

    rows = docs.select(col(id_col).alias("_id"), col(text_col).alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, score double, expected_grade double, tails array<double>, selected boolean") \
        .withColumnRenamed("_id", id_col)


def grades_from_labels(labels: DataFrame, id_col: str = "doc_id", quality: Column | None = None, toxic: Column | None = None) -> DataFrame:
    """Ratings 0 (toxic), 1 (poor), 2 (good) of the labels' two marks; null where a mark is null."""
    quality = F.col("quality") if quality is None else quality
    toxic = F.col("toxic") if toxic is None else toxic
    return labels.select(col(id_col), F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2).alias("grade"))
