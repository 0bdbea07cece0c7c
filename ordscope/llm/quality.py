"""Quality classifier: Naive Bayes support vectors.

Documents become sets of hashed n-grams (words, runs of signs, pairs of these). The
class counts of every n-gram over all labelled training rows give log-count ratios;
a document's vector is its indicators times these ratios. A linear hinge-loss model
over such vectors is fitted by dual coordinate descent, on at most ``fit_rows``
distinct documents of at most ``fit_bytes`` in all, chosen by a hash of id and text; rows
that repeat count as one with their number as weight. Scores are margins through a
logistic curve fitted on the same rows. One task fits that bounded sample; the driver gets
the sizes of its vectors and the model.

The model is one float per hash slot (``2 ** bits``), a fixed size, so it can be sent
to all tasks; scoring has no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordscope.llm.common import batch_of, own_prefix, pick, rows_of, small_batches, text_of
from ordscope.session import materialise

BITS = 18
FIT_ROWS = 8_000
FIT_BYTES = 128 << 20
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_AGAIN = crc32(b"\x00again")
_CACHE_WORDS = 1 << 16


class _Hashes(dict):
    """Token to 32-bit hash; forgets everything when it has grown to ``_CACHE_WORDS``."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = value = crc32(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _Hashes()


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Sorted distinct slots of the n-grams of order 1 and 2 of a whole text.

    A token that repeats the one before it gives the n-gram "again" in place of their
    pair. Only the text counts.
    """
    tokens = _TOKEN.findall(text)
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    pairs[h[:-1] == h[1:]] = _AGAIN
    grams = np.concatenate((h, pairs)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(grams >> np.uint64(64 - bits)).astype(np.int32)


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether crc32 of the id as text falls in the held-out part. A null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


@dataclass
class Model:
    weights: np.ndarray  # per slot: log-count ratio times hinge weight
    bias: float
    slope: float
    offset: float
    bits: int

    def score(self, slots: np.ndarray) -> float:
        margin = self.bias + (float(self.weights[slots].sum()) / np.sqrt(len(slots)) if len(slots) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -35.0, 35.0))))


def fit_hinge(
    rows: list[np.ndarray], ratios: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None, cost: float = 1.0, passes: int = 20
) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear hinge loss: ``weights`` over slots (not yet times ratio) and bias.

    A row's vector is its slots' ratios over the root of their number, and a constant
    1 for the bias. Rows are visited in a fixed pseudorandom order per pass. A row that
    stands for ``times`` equal ones may carry as many times the cost.
    """
    times = np.ones(len(rows)) if times is None else times.astype(float)

    def vector(s: np.ndarray) -> np.ndarray:  # made anew at each visit: kept, they would take as much memory as the rows
        return (ratios[s] / np.sqrt(max(1, len(s)))).astype(np.float32)

    norms = np.array([float(v @ v) + 1.0 for v in map(vector, rows)])
    signs = np.where(labels > 0, 1.0, -1.0)
    # Each class carries half of the cost, however rare it is.
    up = float(times[labels > 0].sum() / times.sum())
    bound = times * cost * 0.5 / np.maximum(np.where(labels > 0, up, 1.0 - up), 1e-9)
    weights, bias, alpha = np.zeros_like(ratios), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(passes):
        worst = 0.0
        for i in order.permutation(len(rows)).tolist():
            value = vector(rows[i])
            gradient = signs[i] * (float(weights[rows[i]] @ value) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), bound[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                weights[rows[i]] += step * value
                bias += step
                worst = max(worst, abs(step))
                alpha[i] = new
        if worst < 1e-3:
            break
    return weights, bias


def fit_curve(margins: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins, by Newton steps with smoothed labels."""
    times = np.ones(len(margins)) if times is None else times.astype(float)
    up, down = float(times[labels > 0].sum()), float(times[labels <= 0].sum())
    wanted = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    design, x = np.stack([margins, np.ones_like(margins)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ x, -35, 35)))
        hessian = design.T @ (design * (times * p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (times * (wanted - p)))
        x = x + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(x[0]), 1e-3), float(x[1])


_SLOTS = pa.schema([("label", pa.int32()), ("pick", pa.int64()), ("slots", pa.binary())])
_COUNTS = pa.schema([("slot", pa.int32()), ("up", pa.int64()), ("down", pa.int64())])
_MODEL = pa.schema([("weights", pa.binary()), ("bias", pa.float64()), ("slope", pa.float64()), ("offset", pa.float64())])


def fit_model(up: np.ndarray, down: np.ndarray, sample: list[tuple], bits: int) -> Model:
    """From the class counts per slot, one added, and the sample's ``pick, slots, label, times`` in any order."""
    ratios = np.log(up / up.sum()) - np.log(down / down.sum())
    sample = sorted(sample, key=lambda row: row[:3])
    y, times = np.array([r[2] for r in sample], np.int64), np.array([r[3] for r in sample], float)
    if len(set(y.tolist())) < 2:
        share = (float((y * times).sum()) + 1) / (times.sum() + 2)
        return Model(np.zeros(1 << bits), 0.0, 1.0, float(np.log(share / (1 - share))), bits)
    slots = [np.frombuffer(r[1], np.int32) for r in sample]
    hinge, bias = fit_hinge(slots, ratios, y, times)
    weights = hinge * ratios
    margins = np.array([weights[s].sum() / np.sqrt(max(1, len(s))) + bias for s in slots])
    slope, offset = fit_curve(margins, y, times)
    return Model(weights, bias, slope, offset, bits)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    bits: int = BITS,
    fit_rows: int = FIT_ROWS,
    fit_bytes: int = FIT_BYTES,
    keep: Column | None = None,
) -> Model:
    """Fit on the labelled rows of ``docs``; ``keep`` (over ``doc_id``) restricts them to training rows.

    Labels are 0 or 1; null labels and labels without a document are ignored. With
    repeated labels for an id the row counts once for each. Without any labelled row,
    or with one class only, the model scores the share of label 1 (0.5 without rows).
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = pick(labels, key=id_col, label=label_col).where("label in (0, 1)")
    rows = pick(docs, doc_id=id_col, text=text_col)
    if keep is not None:
        # On both sides, so that unlabelled and held-out texts are not shuffled.
        rows, known = rows.where(keep), known.withColumn("doc_id", F.col("key")).where(keep).drop("doc_id")
    # Labels grow with the corpus: the same shuffle join at every size, not a broadcast while they happen to be few.
    joined = rows.hint("merge").join(known, F.col("doc_id") == F.col("key")).select(
        F.col("label").cast("int").alias("label"), F.xxhash64(F.lit("fit"), "doc_id", F.col("text")).alias("pick"), text_of().alias("text")
    )

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(_SLOTS, [(y, p, features(t, bits).tobytes()) for y, p, t in rows_of([batch], "label", "pick", "text")])

    vectors = materialise(joined.mapInArrow(slots_of, "label int, pick bigint, slots binary"), "vectors")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << bits), np.int64)
        for y, slots in rows_of(batches, "label", "slots"):
            totals[y][np.frombuffer(slots, np.int32)] += 1
        used = np.flatnonzero(totals.any(axis=0))
        for at in range(0, len(used), 8192):
            some = used[at : at + 8192]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(totals[1][some]), pa.array(totals[0][some])], schema=_COUNTS
            )

    counts = vectors.mapInArrow(count, "slot int, up bigint, down bigint").groupBy("slot").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    # At most 2 ** bits slots, in lists of 1024.
    lists = counts.groupBy(F.shiftright("slot", 10).alias("part")).agg(F.collect_list(F.struct("slot", "up", "down")).alias("counts"))
    lists = materialise(lists.select("counts"), "counts")

    # A share of the rows by their hash; equal rows, of which there may be any number, collapse before they are counted.
    share = min(1.0, fit_rows / max(1, vectors.count()))
    below = min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))
    chosen = vectors.where(F.col("pick") <= below).groupBy("pick", "slots", "label").agg(F.count(F.lit(1)).alias("times"))
    chosen = materialise(chosen.orderBy("pick", "slots", "label").limit(fit_rows), "chosen")
    sizes = chosen.select("pick", F.octet_length("slots").alias("size")).toPandas().sort_values("pick", ignore_index=True)
    upto = sizes["pick"][(sizes["size"].cumsum() <= fit_bytes) | (sizes.index == 0)].max() if len(sizes) else 0
    sample = chosen.where(F.col("pick") <= int(upto)).select(F.struct("pick", "slots", "label", "times").alias("row"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down, rows = np.ones(1 << bits), np.ones(1 << bits), []
        for batch in batches:
            slot, more, less = (c.to_numpy(zero_copy_only=False) for c in batch.column("counts").flatten().flatten())
            up[slot] += more
            down[slot] += less
            rows += [tuple(row.values()) for row in batch.column("row").drop_null().to_pylist()]
        model = fit_model(up, down, rows, bits)
        yield batch_of(_MODEL, [(model.weights.tobytes(), model.bias, model.slope, model.offset)])

    together = sample.unionByName(lists, allowMissingColumns=True).coalesce(1)
    got = together.mapInArrow(fit, "weights binary, bias double, slope double, offset double").first()
    return Model(np.frombuffer(got.weights), got.bias, got.slope, got.offset, bits)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score`` (0 to 1; higher: label 1 likelier). Null text is empty, and empty texts have a score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            scores = [fitted.score(features(t or "", fitted.bits)) for t in batch.column(text_col).to_pylist()]
            columns = [*batch.columns, pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, docs.withColumn(score_col, F.lit(0.0)).schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; learns from rows that are not held out."""
    model = train(docs, labels, id_col, text_col, label_col, keep=~held_out(F.col("doc_id")))
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text_of().alias("text"))
    return score(rows, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, with all their columns."""
    model = train(docs, labels, id_col, text_col, label_col, keep=~held_out(F.col("doc_id")))
    column = f"{own_prefix(docs)}score"
    return score(docs, model, text_col, column).where(F.col(column) >= 0.5).drop(column)
