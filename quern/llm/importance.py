"""Quality by importance resampling.

Two generative models over hashed word n-grams, one of target texts (labelled
good) and one of all raw texts, give each document the logarithm of its
importance weight.  Documents are sampled by that weight with the Gumbel top-k
trick; the mean log ratio of an n-gram, thresholded, says which are kept.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, unfold, with_row
from .counts import packed, summed
from .shingles import mix, slices, word_hashes
from .sift import may_hold

#: Buckets of n-grams: 2**LEAST_BITS for up to 2**LEAST_BITS documents, twice as many for four times the documents, 2**MOST_BITS (64 MB) at most.
LEAST_BITS, MOST_BITS = 16, 24
PAIR = np.uint64(0xD6E8FEB86659FD93)


def bits_for(documents: int) -> int:
    return min(max(LEAST_BITS, LEAST_BITS + math.ceil((documents.bit_length() - LEAST_BITS) / 2)), MOST_BITS)


def grams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of a batch, and where each text's begin."""
    hashes, bounds = word_hashes(texts)
    shift = np.uint64(64 - bits)
    single = (hashes >> shift).astype(np.int64)
    pairs = (mix(hashes[:-1] * PAIR + hashes[1:]) >> shift).astype(np.int64) if len(hashes) else single
    out, at = [], [0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out += [single[a:b], pairs[a : max(a, b - 1)]]
        at.append(at[-1] + (b - a) + max(0, b - a - 1))
    return (np.concatenate(out) if out else single), np.array(at)


def counts(texts: DataFrame, bits: int) -> np.ndarray:
    """Counts of all n-grams of a one-column table of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                total += np.bincount(grams(part, bits)[0], minlength=1 << bits)
        parts = packed(total)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    return summed(texts.mapInArrow(run, "slice int, counts binary"), 1 << bits)


def ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of target over raw probability for each bucket; zero where no target was given."""
    if not target.sum():
        return np.zeros(len(raw))
    p, q = ((c + smoothing) / (c.sum() + smoothing * len(c)) for c in (target, raw))
    return np.log(p) - np.log(q)


def weigh(texts: pa.Array, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams and summed log ratio of each text."""
    n, w = [np.zeros(0, np.int64)], [np.zeros(0)]
    bits = len(ratio).bit_length() - 1
    for part in slices(texts):
        found, at = grams(part, bits)
        n.append(np.diff(at))
        sums = np.add.reduceat(np.concatenate((ratio[found], [0.0])), at[:-1]) if len(part) else np.zeros(0)  # text by text, so a batch's rows don't matter
        w.append(np.where(n[-1] > 0, sums, 0.0))
    return np.concatenate(n), np.concatenate(w)


def marked(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """i, y: the label of each id that has one (the largest of several)."""
    known = labels.select(column(id_col).alias("i"), column(label_col).cast("int").alias("y")).where("i is not null and y is not null")
    return known.groupBy("i").agg(F.max("y").alias("y"))


def labelled(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """t, y: at most `max_rows` labelled texts, those of the smallest id hashes."""
    known = known.orderBy(F.xxhash64("i"), "i").limit(max_rows)
    rows = docs.select(column(id_col).alias("i"), column(text_col).alias("t")).join(F.broadcast(known), "i")
    return rows.groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y"))


def targets(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """t: all texts labelled good; of a repeated id the smallest.  Other rows are told by their id where they are read."""
    good = known.where("y = 1").select("i", F.xxhash64("i").alias("h"))
    rows = docs.select(column(id_col).alias("i"), column(text_col).alias("t")).where("i is not null")
    rows = rows.where(may_hold(good.select("h"), F.xxhash64("i"), good.count()))
    return rows.join(good.select("i"), "i", "left_semi").groupBy("i").agg(F.min("t").alias("t")).select("t")


def cut(samples: DataFrame, ratio: np.ndarray) -> float:
    """The mean log ratio that best parts good from bad samples (balanced); minus infinity without both kinds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, marks = [], []
        for batch in batches:
            n, total = weigh(batch.column(0), ratio)
            means.append(total / np.maximum(n, 1))
            marks.append(np.array(batch.column(1).to_pylist(), float))
        best = None
        if means:
            x, y = np.concatenate(means), np.concatenate(marks)
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            if 0 < y.sum() < len(y):
                bad = np.concatenate(([0], np.cumsum(1 - y))) / (1 - y).sum()
                good = 1 - np.concatenate(([0], np.cumsum(y))) / y.sum()
                k = int(np.argmax(bad + 2 * good))  # a good text lost weighs twice
                best = float(x[k] if k == 0 else (x[k - 1] + x[min(k, len(x) - 1)]) / 2)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(best)])], names=["cut"])

    row = samples.repartition(1).mapInArrow(run, "cut string").first()  # no task without rows
    found = json.loads(row[0]) if row else None
    return -math.inf if found is None else found


def kth_largest(keys: DataFrame, name: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value by counting in ever narrower ranges; None if there are fewer or k is 0."""
    low, high, n = keys.agg(F.min(name), F.max(name), F.count(name)).first()
    if not 0 < k <= n:
        return None
    for _ in range(8):
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        inside = keys.where((F.col(name) >= low) & (F.col(name) <= high))
        held = inside.groupBy(F.least(F.floor((F.col(name) - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(name).alias("a"), F.max(name).alias("b")).collect()
        for r in sorted(held, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                low, high = r["a"], r["b"]
                break
            k -= r["n"]
        if low == high:
            break
    return low


def importance(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float = 0.5, max_rows: int = 12_000, seed: int = 7) -> DataFrame:
    """The input's columns with n_grams, log_weight, score, kept, gumbel_key and sampled.

    The target model counts all texts labelled good, the raw model all texts,
    both into 2**bits_for(rows) buckets; only the threshold is fitted on at most
    `max_rows` labelled texts.  score: mean log ratio of an n-gram squashed to
    (0, 1), 0.5 at the threshold; texts without words score 0.5 and are kept.
    sampled: the ceil(share n) rows of the largest log_weight plus Gumbel noise
    (a hash of seed, id and text, so reruns agree); rows tied with the last are
    sampled too, so repeated rows go together.  Log weights are sums over a
    text's n-grams, so between long texts they outweigh the noise: the method
    samples by importance weights as they are.  Nulls count as empty texts;
    without labels all are kept and sampled evenly; an empty table gives an
    empty table; columns of the new names are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    known = scratch.put(marked(labels, id_col, label_col), "labels")
    samples = scratch.put(labelled(docs, known, id_col, text_col, max_rows).select("t", "y"), "samples")
    rows_in = docs.count()
    bits = bits_for(rows_in)
    ratio = ratios(counts(targets(docs, known, id_col, text_col), bits), counts(docs.select(column(text_col).alias("t")), bits)).astype(np.float32)
    low = cut(samples, ratio)
    shared = spark.sparkContext.broadcast(ratio)

    @F.pandas_udf("n long, w double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n, w = weigh(pa.array(texts, pa.large_string(), from_pandas=True), shared.value)
            yield pd.DataFrame({"n": n.astype("int64"), "w": w})

    rows = with_row(docs, __id=id_col, __text=text_col).withColumn("m", run("__text"))
    mean = F.col("m.w") / F.greatest(F.col("m.n"), F.lit(1))
    point = 0.0 if low == -math.inf else low
    score = F.when(F.col("m.n") > 0, 1 / (1 + F.exp(-20 * (mean - point)))).otherwise(0.5)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "__id", "__text"), 11) + 0.5) / float(1 << 53)
    key = F.col("m.w") - F.log(-F.log(uniform))
    # the keys alone are written to find the last one sampled; texts are weighed again rather than written
    keys = scratch.put(rows.select(key.alias("k")), "keys")
    last = kth_largest(keys, "k", math.ceil(share * rows_in))
    sampled = F.lit(False) if last is None else key >= last
    return unfold(rows, docs.columns, n_grams=F.col("m.n"), log_weight=F.col("m.w"), score=score, kept=(F.col("m.n") == 0) | (mean >= low), gumbel_key=key, sampled=sampled)
