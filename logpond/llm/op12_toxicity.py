"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (``NGRAMS`` letters, with marks for
its ends), each hashed to one of ``BUCKETS`` vectors. The vectors of a window
of ``WINDOW`` words are averaged and go through a linear softmax of two
classes; a document is as toxic as its most toxic window, so one insult in a
long text is not averaged away. Vectors and softmax are trained together, in
numpy, from labels of whole documents (the window that counts is found by a
soft maximum while training). Words that were never seen share the vectors of
their n-grams with words that were.

The model is fitted in one task on a bounded sample: the first ``TRAIN_TOXIC``
toxic and ``TRAIN_CLEAN`` clean labelled documents in the order of a hash,
whole texts, together at most ``TRAIN_BYTES``. Scoring takes every document
and its whole text, and needs only one number per bucket (the vector's product
with the softmax), ``4 * BUCKETS`` bytes, sent to the tasks as a broadcast
variable.

Defined cases: a null or empty text has one empty window; labels of one id are
averaged (toxic from a mean of 0.5), null labels and null ids teach nothing;
texts of equal hash are taken in the order of id and text hash; a row that
repeats id and text is learnt from once and scored each time; without training
rows of both classes every score is the share of toxic ones (0 without any);
an empty table gives an empty result; extra columns are ignored; a very long
text is read in slices of ``SLICE`` characters (a word longer than that is
taken whole), its cost is linear; one that is longer than ``TRAIN_BYTES`` is
not learnt from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logpond.llm.common import pick, saved

NGRAMS = (3, 6)               # shortest and longest
BUCKETS = 1 << 20
WIDTH = 8                     # of a vector
WINDOW = 2
ROUNDS = 60                   # of full-batch training
RATE = 0.1
DECAY = 1.3e-6
MIN_DOCS = 400                # a bucket is learnt if one in so many documents has it (and 3 at least)
TRAIN_TOXIC, TRAIN_CLEAN = 2048, 6144
TRAIN_BYTES = 32 << 20
SLICE = 1 << 20
KNOWN_WORDS = 200_000         # words whose score a scoring task keeps at a time
SEED = 12
HELD_OUT = (4, 2)             # ids with this remainder by crc32 are never learnt from
EDGES = ".,;:!?\"'()[]{}-_*#"


def held_out(id_col: Column) -> Column:
    rest = F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0).cast("long")) % HELD_OUT[0]
    return rest == HELD_OUT[1]


def slices(text: str | None):
    """The words of a text, lower-cased, in lists of bounded size. Every list
    but the last fills whole windows."""
    text = text or ""
    at, rest = 0, []
    while at < len(text):
        end = at + SLICE
        while end < len(text) and not text[end].isspace():
            end += 1
        words = rest + text[at:end].lower().split()
        at = end
        cut = len(words) - len(words) % WINDOW if at < len(text) else len(words)
        rest = words[cut:]
        if cut:
            yield words[:cut]


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of every n-gram, by word. All words are
    hashed at once, as one line of code points."""
    marked = ["<" + w.strip(EDGES) + ">" for w in words]
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words), dtype=np.int32), [len(m) for m in marked])
    buckets, owners = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, NGRAMS[1] + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:] + np.uint64(n)
        if n >= NGRAMS[0]:
            whole = word[:m] == word[n - 1:]
            x = h[whole]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append(((x ^ (x >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(word[:m][whole])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    b, o = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return b[order], o[order]


def _mean(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount(group, values, groups) / np.maximum(np.bincount(group, minlength=groups), 1)


class _Momentum:
    """Gradient descent whose steps have the same length for a whole matrix,
    so n-grams of few documents do not run ahead of common ones."""

    def __init__(self, shape):
        self.m, self.k = np.zeros(shape, np.float32), 0

    def step(self, p: np.ndarray, g: np.ndarray, rate: float) -> None:
        self.k += 1
        self.m *= 0.9
        self.m += np.float32(0.1) * g.astype(np.float32)
        size = float(np.sqrt(np.mean(self.m ** 2, dtype=np.float64))) if self.m.size else 0.0
        if size > 0:
            p -= np.float32(rate / size) * self.m


def train(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): the trained vectors times the difference
    of the two softmax columns, which is all that scoring needs."""
    vocabulary: dict[str, int] = {}
    words, windows, owner = [], [], []
    w = 0
    for k, t in enumerate(texts):
        first = w
        for part in slices(t):
            ids = np.fromiter((vocabulary.setdefault(x, len(vocabulary)) for x in part), np.int32, len(part))
            words.append(ids)
            windows.append(w + np.arange(len(part), dtype=np.int32) // WINDOW)
            w = int(windows[-1][-1]) + 1
        w = max(w, first + 1)
        owner.append(np.full(w - first, k, np.int32))
    word = np.concatenate(words) if words else np.zeros(0, np.int32)
    window = np.concatenate(windows) if windows else np.zeros(0, np.int32)
    doc = np.concatenate(owner)
    n, v = len(texts), len(vocabulary)
    bucket, of = ngrams(list(vocabulary))
    del vocabulary, words, windows, owner

    seen = np.bincount(np.unique(doc[window].astype(np.int64) * max(v, 1) + word) % max(v, 1), minlength=v)
    learnt = np.flatnonzero(np.bincount(bucket, seen[of], BUCKETS) >= max(3, n // MIN_DOCS))
    per_word = np.maximum(np.bincount(of, minlength=v), 1)
    # from here on buckets are numbered among those that are learnt; n-grams
    # of the others only count in the averages
    place = np.full(BUCKETS, -1, np.int32)
    place[learnt] = np.arange(len(learnt), dtype=np.int32)
    bucket = place[bucket]
    of, bucket = of[bucket >= 0], bucket[bucket >= 0]
    per_window = np.maximum(np.bincount(window, minlength=w), 1)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    weight = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (n - toxic.sum()))

    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 0.02, (len(learnt), WIDTH)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
    bias = np.array([1.0, -1.0], np.float32)
    steps = [_Momentum(vectors.shape), _Momentum(softmax.shape), _Momentum(bias.shape)]
    for r in range(ROUNDS):
        rate = RATE * (1 if r < ROUNDS // 2 else 0.5 if r < ROUNDS * 3 // 4 else 0.2)
        toward = softmax[:, 1] - softmax[:, 0]
        by_word = np.bincount(of, (vectors @ toward)[bucket], v) / per_word
        logit = np.bincount(window, by_word[word], w) / per_window + float(bias[1] - bias[0])
        share = np.exp(logit - np.maximum.reduceat(logit, first)[doc])
        share /= np.bincount(doc, share, n)[doc]
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, share * logit, n), -60, 60)))
        slope = (weight * (p - toxic))[doc] * share
        back = np.bincount(word, (slope / per_window)[window], v) / per_word
        g = np.bincount(bucket, back[of], len(learnt))
        turn = vectors.T @ g.astype(np.float32)
        steps[0].step(vectors, np.outer(g, toward) + DECAY * vectors, rate)
        steps[1].step(softmax, np.stack([-turn, turn], axis=1), RATE / 2)
        steps[2].step(bias, np.array([-slope.sum(), slope.sum()]), RATE / 2)
    by_bucket = np.zeros(BUCKETS, np.float32)
    by_bucket[learnt] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return by_bucket, float(bias[1] - bias[0])


class Scorer:
    """Scores texts with ``train``'s numbers; keeps the scores of words."""

    def __init__(self, by_bucket: np.ndarray, bias: float):
        self.by_bucket, self.bias, self.known = by_bucket, bias, {}

    def best(self, texts: list[str | None]) -> np.ndarray:
        """The probability of the most toxic window of each text."""
        out = np.full(len(texts), -np.inf)
        for k, t in enumerate(texts):
            for part in slices(t):
                new = [x for x in set(part) if x not in self.known]
                if new:
                    if len(self.known) + len(new) > KNOWN_WORDS:
                        self.known.clear()
                        new = list(set(part))
                    b, of = ngrams(new)
                    self.known.update(zip(new, _mean(self.by_bucket[b], of, len(new)).tolist()))
                s = np.fromiter(map(self.known.__getitem__, part), np.float64, len(part))
                whole = len(s) - len(s) % WINDOW
                if whole:
                    out[k] = max(out[k], s[:whole].reshape(-1, WINDOW).mean(axis=1).max())
                if whole < len(s):
                    out[k] = max(out[k], s[whole:].mean())
        out[np.isneginf(out)] = 0.0          # an empty window
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -60, 60)))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str, label_col: str) -> DataFrame:
    """id, text and y (0 or 1) of the documents to learn from: bounded, see
    the module's text. Texts are fetched only for the rows chosen."""
    d = pick(docs, id=id_col, t=text_col).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    keyed = d.select("id", F.xxhash64("t").alias("th"), F.coalesce(F.octet_length("t"), F.lit(0)).cast("long").alias("n"))
    y = pick(labels, lid=label_id_col, y=label_col).where("lid is not null and y is not null").groupBy("lid").agg(
        F.when(F.avg("y") >= 0.5, 1).otherwise(0).alias("y"))
    known = saved(keyed.groupBy("id", "th").agg(F.max("n").alias("n")).where(F.col("n") <= TRAIN_BYTES)
                  .join(y, F.col("id") == F.col("lid")).select("id", "th", "n", "y"), "labelled")
    order = [F.xxhash64(F.lit(SEED), "id"), F.col("id"), F.col("th")]
    first = known.where("y = 1").orderBy(*order).limit(TRAIN_TOXIC).unionByName(
        known.where("y = 0").orderBy(*order).limit(TRAIN_CLEAN))
    # at most TRAIN_TOXIC + TRAIN_CLEAN rows: one small window is enough
    sofar = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    chosen = saved(first.withColumn("sofar", sofar).where(F.col("sofar") <= TRAIN_BYTES)
                   .select(F.col("id").alias("cid"), F.col("th").alias("cth"), "y"), "chosen")
    rows = d.join(F.broadcast(chosen), (F.col("id") == F.col("cid")) & (F.xxhash64("t") == F.col("cth")))
    return rows.groupBy("cid", "cth").agg(F.first("t").alias("t"), F.first("y").alias("y")).select(
        F.col("cid").alias("id"), F.col("cth").alias("th"), F.coalesce("t", F.lit("")).alias("t"), "y")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_id_col: str = "doc_id", label_col: str = "toxic") -> tuple[np.ndarray, float] | float:
    """The model, or the share of toxic rows when one class is missing."""
    rows = saved(sample(docs, labels, id_col, text_col, label_id_col, label_col), "train")
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    if seen["toxic"] in (0, seen["n"]):
        return float(seen["toxic"] / seen["n"]) if seen["n"] else 0.0

    def one(pdf):
        import pandas as pd
        pdf = pdf.sort_values(["id", "th"])
        by_bucket, bias = train(pdf["t"].tolist(), pdf["y"].to_numpy(np.float64))
        return pd.DataFrame({"m": [by_bucket.tobytes()], "bias": [bias]})

    model = rows.withColumn("k", F.lit(1)).groupBy("k").applyInPandas(one, "m binary, bias double").first()
    return np.frombuffer(model["m"], np.float32), model["bias"]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score in [0, 1]: one row per input row."""
    model = fit(docs, labels, id_col, text_col)
    d = pick(docs, id=id_col, t=text_col)
    if isinstance(model, float):
        return d.select("id", held_out(F.col("id")).alias("held_out"), F.lit(model).alias("score"))
    sent = d.sparkSession.sparkContext.broadcast(model)
    schema = d.select("id", F.lit(0.0).alias("score")).schema

    def each(batches):
        scorer = Scorer(*sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scorer.best(b.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    return d.mapInArrow(each, schema).select("id", held_out(F.col("id")).alias("held_out"), "score")
