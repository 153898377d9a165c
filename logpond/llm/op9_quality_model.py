"""Quality classifier: random Fourier features of document statistics, ridge
regression by partition-summed normal equations, isotonic calibration.

Statistics come from the text alone. They are standardised with the means
and deviations of all documents, mapped to ``FEATURES`` random Fourier
features, which approximate a Gaussian kernel, and every labelled training
row adds to X'X and X'y: a partition sends one matrix of fixed size, and the
matrices are summed in a tree. The raw scores of the training rows are
counted into ``BINS`` fixed bins by label, and pool-adjacent-violators over
the bins gives the calibrated score. Nothing that reaches the driver grows
with the documents.

Defined cases: a null or empty text has the statistics of an empty text and
gets a score; labels of one id are averaged (1 from a mean of 0.5), null
labels and null ids teach nothing; without training rows every score is 0.5;
repeated rows are scored each; an empty table gives an empty result; extra
columns are ignored; statistics are linear in the text's length.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logpond.llm.common import pick, saved

FEATURES = 192
RIDGE = 1.0
BINS = 2000                   # of raw scores in [LOW, HIGH]
LOW, HIGH = -0.5, 1.5
SEED = 9
HELD_OUT = 5                  # every fifth id by crc32 is never learnt from

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_STOPS = np.frombuffer(b".,;:", np.uint8)
STATISTICS = ("words", "word_length", "distinct", "same_next", "short_words", "upper", "digits", "symbols", "stops",
              "shouts", "beyond_ascii", "line_feeds", "dup_lines", "entropy", "first_upper", "words_a_line")


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    words = raw.split()
    k = len(words)
    if not k:
        return [0.0] * len(STATISTICS)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    share = c[c > 0] / n
    chars = n - int(c[9:14].sum()) - int(c[32])
    starts = bytes(w[0] for w in words)
    return [
        np.log1p(k), chars / k, len(set(words)) / k, sum(map(eq, words, words[1:])) / k,
        sum(len(w) <= 1 for w in words) / k, upper / (upper + lower + 1), int(c[48:58].sum()) / n,
        int(c[_SYMBOLS].sum()) / k, int(c[_STOPS].sum()) / k, int(c[33]) / k, int(c[128:].sum()) / n,
        int(c[10]) / k, 1 - len(set(lines)) / len(lines), float(-(share * np.log2(share)).sum()),
        sum(65 <= s <= 90 for s in starts) / k, np.log1p(k / len(lines)),
    ]


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    at = batch.schema.get_field_index
    return np.stack([batch.column(at(x)).to_numpy(zero_copy_only=False) for x in names], axis=1).astype(np.float64)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and one column per statistic: one row per input row."""
    d = pick(docs, id=id_col, t=text_col)
    schema = d.select("id", *[F.lit(0.0).alias(f"s_{x}") for x in STATISTICS]).schema

    def each(batches):
        for b in batches:
            s = np.array([statistics(t.as_py()) for t in b.column(1)], dtype=np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x) for x in s.T]], names=schema.names)

    return d.mapInArrow(each, schema)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0).cast("long")) % HELD_OUT == 0


class Model:
    """What scoring needs: a few arrays of fixed size."""

    def __init__(self, mean, deviation):
        rng = np.random.default_rng(SEED)
        d = len(STATISTICS)
        self.mean, self.deviation = np.asarray(mean), np.asarray(deviation)
        self.waves = rng.normal(0, 1 / np.sqrt(d), (d, FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.steps = np.full(BINS, 0.5)

    def mapped(self, s: np.ndarray) -> np.ndarray:
        x = np.clip((s - self.mean) / self.deviation, -6, 6)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.waves + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])

    def bins(self, s: np.ndarray) -> np.ndarray:
        raw = self.mapped(s) @ self.weights
        return np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)

    def scores(self, s: np.ndarray) -> np.ndarray:
        return self.steps[self.bins(s)]


def isotonic(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing fit (pool adjacent violators) of ones / total over the
    bins; bins without rows take the value below them, the first ones that
    of the first bin with rows."""
    blocks: list[list] = []            # [ones, total, bins]
    for i in np.flatnonzero(total).tolist():
        blocks.append([float(ones[i]), float(total[i]), [i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            o, t, b = blocks.pop()
            blocks[-1][0] += o
            blocks[-1][1] += t
            blocks[-1][2] += b
    out = np.full(len(total), np.nan)
    for o, t, b in blocks:
        out[b] = o / t
    last = blocks[0][0] / blocks[0][1] if blocks else 0.5
    for i in range(len(out)):
        last = out[i] = last if np.isnan(out[i]) else out[i]
    return out


def fit(stats: DataFrame, labels: DataFrame, label_id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learns from the rows of ``stats`` that have a label and are not held
    out."""
    names = [f"s_{x}" for x in STATISTICS]
    agg = stats.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(names)],
                    *[F.stddev_pop(x).alias(f"d{i}") for i, x in enumerate(names)]).first()
    n = len(names)
    model = Model([agg[f"m{i}"] or 0.0 for i in range(n)], [(agg[f"d{i}"] or 0.0) + 1e-6 for i in range(n)])
    lab = pick(labels, lid=label_id_col, y=label_col).where("lid is not null and y is not null").groupBy("lid").agg(
        F.when(F.avg("y") >= 0.5, 1.0).otherwise(0.0).alias("y"))
    train = saved(stats.where(~held_out(F.col("id"))).join(lab, F.col("id") == F.col("lid")).select(*names, "y"), "train")

    def sums(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            z = model.mapped(_matrix(b, names))
            total += z.T @ np.hstack([z, _matrix(b, ["y"])])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(a: bytes, b: bytes) -> bytes:
        return (np.frombuffer(a) + np.frombuffer(b)).tobytes()

    parts = train.mapInArrow(sums, "m binary").rdd.map(lambda r: bytes(r["m"]))
    total = parts.treeReduce(add, depth=2) if parts.getNumPartitions() else b""
    if not total:
        return model
    m = np.frombuffer(total).reshape(FEATURES + 1, FEATURES + 2)
    if not m[-1, -2]:                  # the constant's square: the number of rows
        return model
    ridge = RIDGE * np.eye(FEATURES + 1)
    ridge[-1, -1] = 0
    model.weights = np.linalg.solve(m[:, :-1] + ridge, m[:, -1])

    def counted(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(model.bins(_matrix(b, names))), pa.array(_matrix(b, ["y"])[:, 0])], names=["bin", "y"])

    ones, rows = np.zeros(BINS), np.zeros(BINS)
    for r in train.mapInArrow(counted, "bin long, y double").groupBy("bin").agg(
            F.sum("y").alias("y"), F.count("*").alias("n")).collect():          # at most BINS rows
        ones[r["bin"]], rows[r["bin"]] = r["y"], r["n"]
    model.steps = isotonic(ones, rows)
    return model


def score_rows(stats: DataFrame, model: Model) -> DataFrame:
    """id, score."""
    names = [f"s_{x}" for x in STATISTICS]
    schema = stats.select("id", F.lit(0.0).alias("score")).schema

    def each(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("id")), pa.array(model.scores(_matrix(b, names)))], names=["id", "score"])

    return stats.mapInArrow(each, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score in [0, 1]: one row per input row."""
    stats = saved(measured(docs, id_col, text_col), "statistics")
    return score_rows(stats, fit(stats, labels)).select("id", held_out(F.col("id")).alias("held_out"), "score")


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that score ``least`` or more.
    Statistics are made again as the texts pass, so no text is shuffled."""
    model = fit(saved(measured(docs, id_col, text_col), "statistics"), labels)
    at = docs.columns.index(text_col)
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def each(batches):
        for b in batches:
            if b.num_rows:
                s = np.array([statistics(t.as_py()) for t in b.column(at)], dtype=np.float64)
                yield b.filter(pa.array(model.scores(s) >= least))

    return flat.mapInArrow(each, flat.schema).toDF(*docs.columns)
