"""Quality classifier (operator 1): random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of whole texts are standardised and mapped to cosines of random projections, whose inner products
approximate a Gaussian kernel. Each partition sums its part of the normal equations, by fold of the training rows;
the parts are added up row by row, and solved on the driver (their size depends on the number of features alone).
Out-of-fold scores, counted in fixed bins, are calibrated by pooling adjacent violators.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chosen, column, fields_of, free_name, kept_as, map_arrow, stored

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "deviation_word", "upper", "digit", "space", "mark", "stop", "symbol", "bar", "bang",
    "other", "distinct_words", "log_line", "repeated_lines", "short_words", "marked_words", "upper_words", "entropy",
)
FOLDS, BINS = 5, 2048


def _group(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_GROUPS = [
    _group(bytes(range(65, 91))), _group(b"0123456789"), _group(b" \t\n\r\x0b\x0c"), _group(b",;:'\"()-"), _group(b".?"), _group(b"#$%&*@^~=+<>{}[]\\/_`"),
    _group(b"|"), _group(b"!"), _group(bytes(range(128, 256))),
]


def statistics(text: str | None) -> list[float]:
    """The figures named in ``STATISTICS`` of one whole text; null counts as empty, and all are finite."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=float, count=len(words)) if words else np.zeros(1)
    lines = data.split(b"\n")
    marked = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128)
    shares = [float(counts[g].sum()) / n for g in _GROUPS]
    p = counts[counts > 0] / n
    return [
        math.log1p(len(data)), math.log1p(len(words)), float(lengths.mean()), float(lengths.std()), *shares,
        len(set(words)) / k, math.log1p(len(data) / len(lines)), 1 - len(set(lines)) / len(lines), float((lengths <= 3).sum()) / k,
        marked / k, sum(map(bytes.isupper, words)) / k, float(-(p * np.log2(p)).sum()) if len(data) else 0.0,
    ]


def with_statistics(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``stats`` (array of float) of every row; map-only."""
    names = kept_as(keep, ["stats"])
    at = free_name(list(names), "text_")
    slim = docs.select(*chosen(keep, names), column(text).alias(at))
    fields = fields_of(slim.drop(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*names, "stats"])

    return map_arrow(slim, run, ", ".join([*fields, "stats array<float>"]))


@dataclass
class Features:
    """Standardisation and random projections; ``width`` is the Gaussian kernel's, in standard deviations."""

    mean: np.ndarray
    scale: np.ndarray
    count: int = 256
    width: float = 4.0
    seed: int = 7

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(size=(len(self.mean), self.count)) / self.width
        b = rng.uniform(0, 2 * np.pi, self.count)
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        cosines = np.sqrt(2 / self.count) * np.cos(z @ w + b)
        return np.concatenate([cosines, z / 8, np.ones((len(z), 1))], axis=1)


@dataclass
class Model:
    features: Features
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores, 0 to 1: linear between the calibration's knots."""
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def _matrix(batch: pa.RecordBatch, column: str = "stats") -> np.ndarray:
    flat = batch.column(batch.schema.names.index(column)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, len(STATISTICS)).astype(float)


def _summed(train: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], rows: int, width: int) -> np.ndarray:
    """Sum over the batches of ``f``, a matrix: by partition first, then row by row of the matrix.

    A row is added up by one task as its parts stream in, in order of partition; the driver gets the matrix once.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                own = f(batch)
                total = own if total is None else total + own
        if total is not None:
            for a in range(0, rows, 256):
                lines = [x.tobytes() for x in total[a : a + 256]]
                number = np.arange(a, a + len(lines), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.full(len(lines), TaskContext.get().partitionId(), dtype=np.int32)), pa.array(lines, pa.binary())], names=["row", "part", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, v in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                own = np.frombuffer(v.as_py())
                sums[row] = sums[row] + own if row in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["row", "v"])

    parts = map_arrow(train, part, "row int, part int, v binary").repartition("row").sortWithinPartitions("row", "part")
    out = np.zeros((rows, width))
    for r in map_arrow(parts, add, "row int, v binary").collect():  # a matrix whose size depends on the features alone
        out[r["row"]] = np.frombuffer(r["v"])
    return out


def fit(train: DataFrame, count: int = 256, ridge: float = 1e-2, width: float = 4.0) -> Model:
    """A model from ``train``: ``stats``, ``label`` (0 or 1) and ``fold``. Without rows of both labels it scores all alike."""
    train = checkpointed(train.where("label is not null").select("stats", F.col("label").cast("double").alias("label"), "fold"))
    d = len(STATISTICS)
    moments = train.select(F.posexplode("stats").alias("i", "x"), "label").groupBy("i").agg(
        F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("dev"), F.avg("label").alias("rate"), F.count(F.lit(1)).alias("n")
    ).collect()  # one row for each statistic
    mean, scale = np.zeros(d), np.ones(d)
    for r in moments:
        mean[r["i"]], scale[r["i"]] = r["mean"], max(r["dev"], 1e-6)
    features = Features(mean, scale, count, width)
    rate = moments[0]["rate"] if moments else 0.5
    m = count + d + 1
    if not moments or not 0 < rate < 1:
        return Model(features, np.zeros(m), np.array([0.0, 1.0]), np.array([rate, rate]))

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        """By fold, the features' products with each other and, as the last column, with the label."""
        x, y, folds = features(_matrix(batch)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        both = np.concatenate([x, y[:, None]], axis=1)
        return np.concatenate([x[folds == k].T @ both[folds == k] for k in range(FOLDS)])

    total = _summed(train, sums, FOLDS * m, m + 1).reshape(FOLDS, m, m + 1)
    a, b = total[:, :, :m], total[:, :, m]
    n = moments[0]["n"]
    solve = lambda aa, bb: np.linalg.solve(aa + ridge * max(1.0, n / 1000) * np.eye(m), bb)
    weights = solve(a.sum(0), b.sum(0))
    held = np.stack([solve(a.sum(0) - a[k], b.sum(0) - b[k]) for k in range(FOLDS)])
    low, high = -0.5, 1.5

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        """Rows and ones by bin of the score of the model that did not see the row."""
        raw = (features(_matrix(batch)) * held[batch.column(2).to_numpy()]).sum(axis=1)
        at = np.clip(((raw - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, batch.column(1).to_numpy(), BINS)]).reshape(32, -1)

    bins = _summed(train, binned, 32, BINS // 16).reshape(2, BINS).T
    knots, levels = calibrate(low + (np.arange(BINS) + 0.5) * (high - low) / BINS, bins[:, 0], bins[:, 1])
    return Model(features, weights, knots, levels)


def calibrate(centres: np.ndarray, counts: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of the share of ones by score: pool adjacent violators, knots at the blocks' mean scores.

    A slope of a millionth keeps the order of scores within a block.
    """
    blocks: list[list[float]] = []  # count, ones, count x centre, last
    for c, n, y in zip(centres, counts, ones, strict=True):
        if n:
            blocks.append([n, y, n * c])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                last = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    x = np.array([b[2] / b[0] for b in blocks])
    y = np.array([(b[1] + 0.01) / (b[0] + 0.02) for b in blocks])
    x = np.concatenate([[min(-1.0, x[0] - 1)], x, [max(2.0, x[-1] + 1)]])
    y = np.concatenate([[max(0.0, y[0] - 1e-6)], y, [min(1.0, y[-1] + 1e-6)]])
    return x, np.maximum.accumulate(y)


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with its array replaced by ``score``; map-only."""
    fields = fields_of(stats.drop("stats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("stats")
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for n in batch.schema.names if n != "stats"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.score(_matrix(batch)))], names=[*names, "score"])

    return map_arrow(stats, run, ", ".join([*fields, "score double"]))


def held_out(key: str = "doc_id"):
    """Rows kept from training: crc32 of the key as text leaves 2 modulo 4; rows with a null key as well."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _trained(rows: DataFrame, labels: DataFrame, key: str, label: str, count: int) -> Model:
    named = labels.select(column(key).alias("key"), column(label).alias("label")).where("key is not null and label is not null")
    train = rows.join(named, "key").where(~held_out("key"))
    fold = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(FOLDS)).cast("int")
    return fit(train.select("stats", "label", fold.alias("fold")), count)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, count: int = 256, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Per row: ``key``, held_out, score (0 to 1) and predicted (1 from ``threshold`` on).

    Labels are taken from rows that are not held out, a null label from none; a key labelled more than once takes
    part with each label. Scores are a function of the text alone: null and empty texts share one, repeated rows
    score alike. An empty table gives no rows; with no labels of one kind all scores are the share of ones (0.5
    without any). Other columns are not read.
    """
    rows = stored(with_statistics(docs.select(column(key).alias("key"), column(text).alias("text")), ("key",)), "stats")
    out = scored(rows, _trained(rows, labels, key, label, count))
    return out.select(F.col("key").alias(key), held_out("key").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, count: int = 256, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that ``classify`` would predict 1, with all their columns; the filter moves no text."""
    slim = docs.select(column(key).alias("key"), column(text).alias("text"))
    model = _trained(with_statistics(slim, ("key",)), labels, key, label, count)
    at = docs.columns.index(text)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t.as_py()) for t in batch.column(at)], dtype=np.float32).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.score(stats.astype(float)) >= threshold))

    return map_arrow(docs, good, docs.schema)
