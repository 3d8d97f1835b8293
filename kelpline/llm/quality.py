"""Quality scores from document statistics.

Random Fourier features approximate a Gaussian kernel over statistics of the
whole text; ridge regression on them is solved from normal equations summed
over partitions; isotonic regression turns its output into a probability.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import Workspace, materialise

#: Frequent function words of the languages at hand.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that it for on with as was be by at are this from or "
    b"der die und das den von zu mit sich des auf ist im nicht ein eine "
    b"de la le et les des en un une du que est pour dans par sur "
    b"el los las del y se una su con por como".split()
)
#: Statistics of a text, in the order that `statistics` returns them.
STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_sd", "upper", "digits", "white", "newlines", "high_bytes",
    "stops", "exclaim", "symbols", "bars", "other_marks", "distinct_words", "top_word", "repeated_lines", "line_words",
    "shouted_words", "marked_words", "short_words", "function_words", "entropy", "squeezed", "next_repeats",
)
#: Score bins of the calibration and the range of raw scores that they cover.
BINS, LOW, HIGH = 2048, -0.5, 1.5


def statistics(text: str | None) -> list[float]:
    """What the classifier sees of a text: shape and wording, never its labels or source."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = lambda chars: float(hist[list(chars)].sum()) / n
    words = raw.split()
    w = max(len(words), 1)
    lengths = np.array([len(x) for x in words] or [0])
    lower = [x.lower() for x in words]
    counts = Counter(lower)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = hist[hist > 0] / n
    ends = Counter(x[-1] for x in words)
    marked = sum(c for b, c in ends.items() if b in b"!#$%&*@^~|=+<>")
    return [
        np.log1p(len(raw)), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()),
        share(range(65, 91)), share(range(48, 58)), share(b" \t\r\n\x0b\x0c"), share(b"\n"), float(hist[128:].sum()) / n,
        share(b".,;:?"), share(b"!"), share(b"#$%&*@^~"), share(b"|"), share(b"\"'()[]{}<>/\\=+-_`"),
        len(counts) / w, counts.most_common(1)[0][1] / w if counts else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0, len(words) / max(len(lines), 1),
        sum(x.isupper() and len(x) > 1 for x in words) / w, marked / w, float((lengths <= 2).sum()) / w,
        sum(c for x, c in counts.items() if x in FUNCTION_WORDS) / w, float(-(p * np.log2(p)).sum()) if len(raw) else 0.0,
        len(zlib.compress(raw, 1)) / n, sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / w,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the statistics of each whole text (null: empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("stats", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            stats = [np.asarray(statistics(t.as_py()), dtype=np.float32) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(stats, pa.list_(pa.float32()))], schema=schema)

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, stats array<float>")


class Model:
    """Standardisation, random features, weights and calibration; a few kB."""

    def __init__(self, mean, scale, omega, phase, weights, knots, values):
        self.mean, self.scale, self.omega, self.phase, self.weights, self.knots, self.values = mean, scale, omega, phase, weights, knots, values

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return features(stats, self.mean, self.scale, self.omega, self.phase) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw score orders ties."""
        raw = self.raw(stats)
        flat = np.interp(raw, self.knots, self.values)
        return np.clip(0.999 * flat + 0.001 * np.clip((raw - LOW) / (HIGH - LOW), 0, 1), 0, 1)


def features(stats: np.ndarray, mean, scale, omega, phase) -> np.ndarray:
    x = np.clip((stats - mean) / scale, -6, 6)
    return np.hstack([np.cos(x @ omega + phase) * np.sqrt(2 / omega.shape[1]), np.ones((len(x), 1))])


def _stats_of(batch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("stats"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS)).astype(np.float64)


def isotonic(n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Non-decreasing fit of the means y / n, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for weight, total in zip(n, y, strict=True):
        pools.append([float(weight), float(total), 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), t / w) for w, t, k in pools])


def fit(labelled: DataFrame, size: int = 160, widths: tuple[float, ...] = (1.0, 2.0), ridges: tuple[float, ...] = (1e-4, 1e-3, 1e-2), seed: int = 11) -> Model | float:
    """Fit on rows (fold 0/1, stats, label); all of them, in two passes of sums.

    ``widths``: candidates for the kernel's width, times the square root of
    the number of statistics. Width and ridge are those with the least squared error across the
    two folds, which follows from the summed equations alone. Calibration uses
    scores of the fold that the weights did not see. Without both labels the
    result is a constant score: the label's mean, or 0.5 without any label.

    The driver gets the summed equations ((size + 1)**2 numbers a width and
    fold) and BINS counts, whatever the number of rows.
    """
    d = len(STATISTICS)

    def moments(batches):
        total = np.zeros((3, d + 1))
        for batch in batches:
            x = _stats_of(batch)
            total += [[*x.sum(0), len(x)], [*(x**2).sum(0), 0], [*np.zeros(d), batch.column(batch.schema.get_field_index("label")).to_numpy().sum()]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    flat = np.zeros(3 * (d + 1))
    for at, v in labelled.mapInArrow(moments, "at long, v double").groupBy("at").sum("v").collect():
        flat[at] = v
    sums = flat.reshape(3, d + 1)
    n, ones = sums[0, d], sums[2, d]
    if n == 0 or ones in (0, n):
        return float(ones / n) if n else 0.5
    mean = sums[0, :d] / n
    scale = np.sqrt(np.maximum(sums[1, :d] / n - mean**2, 0)) + 1e-3
    rng = np.random.default_rng(seed)
    base, phase = rng.standard_normal((d, size)), rng.uniform(0, 2 * np.pi, size)
    omegas = [base / (w * np.sqrt(d)) for w in widths]
    m = size + 2  # the features, one, and the label

    def equations(batches):
        total = np.zeros((len(omegas), 2, m, m))
        for batch in batches:
            x, y = _stats_of(batch), batch.column(batch.schema.get_field_index("label")).to_numpy()
            fold = batch.column(batch.schema.get_field_index("fold")).to_numpy()
            for k, omega in enumerate(omegas):
                z = np.hstack([features(x, mean, scale, omega, phase), y[:, None]])
                for f in (0, 1):
                    total[k, f] += z[fold == f].T @ z[fold == f]
        rows = total.reshape(-1, m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names=["at", *names])

    names = [f"c{i}" for i in range(m)]
    summed = np.zeros((len(omegas) * 2 * m, m))
    for row in labelled.mapInArrow(equations, "at long, " + ", ".join(f"{c} double" for c in names)).groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).collect():
        summed[row[0]] = row[1:]
    summed = summed.reshape(len(omegas), 2, m, m)

    def solve(eq: np.ndarray, ridge: float) -> np.ndarray:
        penalty = ridge * max(eq[m - 2, m - 2], 1) * np.eye(m - 1)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(eq[:-1, :-1] + penalty, eq[:-1, -1])

    def error(eq: np.ndarray, w: np.ndarray) -> float:
        return float(w @ eq[:-1, :-1] @ w - 2 * w @ eq[:-1, -1] + eq[-1, -1])

    tried = [(error(s[1], solve(s[0], r)) + error(s[0], solve(s[1], r)), k, r) for k, s in enumerate(summed) for r in ridges]
    _, k, ridge = min(tried)
    crossed = [solve(summed[k][1], ridge), solve(summed[k][0], ridge)]  # by the fold that they score
    weights = solve(summed[k].sum(0), ridge)
    omega = omegas[k]

    def binned(batches):
        total = np.zeros((2, BINS))
        for batch in batches:
            z = features(_stats_of(batch), mean, scale, omega, phase)
            fold = batch.column(batch.schema.get_field_index("fold")).to_numpy()
            raw = np.where(fold == 0, z @ crossed[0], z @ crossed[1])
            at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
            total[0] += np.bincount(at, minlength=BINS)
            total[1] += np.bincount(at, weights=batch.column(batch.schema.get_field_index("label")).to_numpy(), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(total[0]), pa.array(total[1])], names=["at", "n", "y"])

    bins = np.zeros((2, BINS))
    for at, c, y in labelled.mapInArrow(binned, "at long, n double, y double").groupBy("at").agg(F.sum("n"), F.sum("y")).collect():
        bins[:, at] = c, y
    used = np.nonzero(bins[0])[0]
    centre = LOW + (used + 0.5) * (HIGH - LOW) / BINS
    return Model(mean, scale, omega, phase, weights, centre, isotonic(bins[0][used], bins[1][used]))


def fitted(stats: DataFrame, labels: DataFrame) -> Model | float:
    """The model of the labelled rows of a written table of statistics that are not held out."""
    mean = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")
    labelled = stats.select("doc_id", "held_out", "stats").where("not held_out").join(mean, "doc_id").select(fold, "stats", "label").persist()
    model = fit(labelled)
    labelled.unpersist()
    return model


def scores_of(model: Model | float, stats: np.ndarray) -> np.ndarray:
    return np.full(len(stats), model) if isinstance(model, float) else model.scores(stats)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Learns from labelled documents that are not held out: those whose
    crc32(doc_id as text) is not divisible by 5 (a null doc_id counts as an
    empty text, is held out and has no label). Several labels of a doc_id
    count as their mean; null labels don't count. Null and empty texts are
    scored like any other text; equal texts get equal scores.

    Scale: texts are read once; a hundred bytes of statistics a document go to
    the shared folder and serve both the fit and the scores.
    """
    stats = materialise(with_statistics(docs))
    model = fitted(stats, labels)

    def run(batches):
        for batch in batches:
            x = _stats_of(batch)
            score = scores_of(model, x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns.

    Each row is judged by its own text, so rows that share a doc_id, or have
    none, are judged apart. Learns as `classify` does. An empty table gives an
    empty result; columns of any names are kept.

    Scale: texts are read twice, once for the fit and once for the scores, and
    no row is written or shuffled but the statistics of the first reading, which
    are deleted once the model is fitted.
    """
    space = Workspace(docs.sparkSession)
    model = fitted(space.keep(with_statistics(docs)), labels)
    space.drop()

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], dtype=np.float32).reshape(len(texts), len(STATISTICS)).astype(np.float64)
        return pd.Series(scores_of(model, x))

    return docs.where(score(F.coalesce(F.col("text").cast("string"), F.lit(""))) >= threshold)
