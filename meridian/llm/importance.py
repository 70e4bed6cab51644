"""Quality by importance resampling: hashed n-gram generative models, sampled by Gumbel top-k.

Two bag models over the same hash buckets are counted: the target's, from documents that
labels call good, and the raw corpus's, from every document. A document's log weight is
the log ratio of its probability under both. Adding Gumbel noise keyed by the document
and keeping the k largest draws k documents without replacement in proportion to their
weights. k is stated, or else the number of documents whose weight reaches a low quantile
of held-out good documents, so that the sample has room for all that look like the target.

A document stands for at most ``full`` n-grams, in the models and in its own weight alike:
a longer one counts, and is weighed, like ``full`` n-grams of its average. Otherwise a few
very long texts would decide what the corpus is like, and weights would be so far apart
that noise never decides between two documents. Counts are kept in whole units, so that
they add up alike in any order.

The n-grams are byte trigrams of the single-spaced text and word pairs; a word that
repeats its predecessor counts as one token of its own kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import stable, stored, table, tidy
from meridian.llm.words import ODD, Words, mix, normal, packs

PACK_BYTES = 1 << 19
#: Units of a count of one.
UNIT = 1 << 20


@dataclass(frozen=True)
class Plan:
    """bits: log2 of the hash buckets; labelled: good documents that the target model and its quantile are
    fitted on, about half each; k: documents to draw; without it, lost: the share of held-out good documents
    below the weight that sets k; prior: the count with which a bucket's ratio of target to raw share is drawn
    to 1, so that buckets the target's sample is too small to tell stay neutral; full: n-grams that a document
    stands for at most."""

    bits: int = 16
    labelled: int = 20_000
    k: int | None = None
    lost: float = 0.001
    prior: float = 5.0
    full: int = 64
    seed: int = 42


def buckets(lines: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of some single-spaced texts, and the text of each."""
    shift = np.uint64(64 - bits)
    words = Words(lines)
    a = np.frombuffer(words.buf, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1) - 1  # of each text in the buffer
    grams, of = [], []
    if len(a) >= 3:
        whole = (a[:-2] != 10) & (a[1:-1] != 10) & (a[2:] != 10)
        b = a.astype(np.uint64)
        key = ((b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:])[whole]
        grams.append((mix(key + np.uint64(1)) >> shift).astype(np.int64))
        of.append(np.searchsorted(ends, np.flatnonzero(whole), "right"))
    if len(words.hash) > 1:
        line = np.repeat(np.arange(len(lines)), words.count)
        pair = line[1:] == line[:-1]
        left, right = words.hash[:-1][pair], words.hash[1:][pair]
        key = np.where(left == right, np.uint64(0x7265706561740000), mix(left) + right * ODD)
        grams.append((mix(key) >> shift).astype(np.int64))
        of.append(line[1:][pair])
    if not grams:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(grams), np.concatenate(of)


def count(docs: DataFrame, good: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(target, raw) counts of the buckets: raw over every document, target over those whose doc_id is in good.

    Tasks send their count vectors in slices, which are added up before anything reaches the driver; what
    arrives there is two vectors.
    """
    slices = 64
    wide = (1 << plan.bits) // slices
    schema = "slice int, counts binary"

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << plan.bits), np.int64)
        rows = ((t.as_py() or b"", d) for b in batches for t, d in zip(b.column(1), b.column(0).to_pylist(), strict=True))
        for pack in packs(rows, PACK_BYTES):
            grams, of = buckets([normal(t) for t, _ in pack], plan.bits)
            n = np.bincount(of, minlength=len(pack))
            unit = (UNIT * plan.full // np.maximum(n, plan.full))[of]  # sums stay exact: under 2^53 for each pack
            sums[1] += np.bincount(grams, unit, minlength=1 << plan.bits).astype(np.int64)
            mine = np.isin(np.array([np.iinfo(np.int64).min if d is None else d for _, d in pack], np.int64), good)
            if mine.any():
                sums[0] += np.bincount(grams[mine[of]], unit[mine[of]], minlength=1 << plan.bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * slices), pa.int32()), pa.array([s.tobytes() for s in sums.reshape(2 * slices, wide)])], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["slice", "counts"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = texts.mapInArrow(tidy(tally), schema).repartition(slices, "slice").mapInArrow(tidy(add), schema).collect()
    both = np.zeros((2 * slices, wide), np.int64)
    for r in rows:
        both[r.slice] += np.frombuffer(r.counts, np.int64)
    target, raw = both.reshape(2, -1)
    return target, raw


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float) -> np.ndarray:
    """log of target share over raw share by bucket; the target's shares add up to 1."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    share = raw / raw.sum()
    ratio = (target + prior) / (target.sum() * share + prior)
    return np.log(ratio) - np.log((share * ratio).sum())


def good_labels(labels: DataFrame, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids of a bounded sample of good labels, for fitting and for the quantile."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    n = good.count()
    share = int(min(1.0, plan.labelled / max(1, n)) * (1 << 30))
    ids = [r.doc_id for r in good.filter(F.pmod(F.xxhash64(F.lit(plan.seed), "doc_id"), F.lit(1 << 30)) < share).collect()]
    ids = np.unique(np.array(ids, np.int64))
    half = mix(ids.view(np.uint64) + np.uint64(1)) >> np.uint64(63) == 1
    return ids[half], ids[~half]


def weighted(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), columns: list[str] | None = None) -> tuple[DataFrame, np.ndarray]:
    """docs' columns with iw_log (log weight) and iw_key (log weight with Gumbel noise), and the held-out good doc_ids."""
    fit, held = good_labels(labels, plan)
    target, raw = count(docs, fit, plan)
    ratio = log_ratio(target / UNIT, raw / UNIT, plan.prior)
    columns = columns or docs.columns
    text, ident = columns.index("text"), columns.index("doc_id")
    names = [*columns, "iw_log", "iw_key"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, at = np.zeros(b.num_rows), 0
            for pack in packs((((t.as_py() or "").encode(),) for t in b.column(text)), PACK_BYTES):
                grams, of = buckets([normal(t) for (t,) in pack], plan.bits)
                n = np.bincount(of, minlength=len(pack))
                out[at : at + len(pack)] = np.bincount(of, ratio[grams], minlength=len(pack)) * plan.full / np.maximum(n, plan.full)
                at += len(pack)
            ids = np.array([-1 if d is None else d for d in b.column(ident).to_pylist()], np.int64).view(np.uint64)
            u = ((mix(mix(ids + ODD) + np.uint64(plan.seed)) >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out), pa.array(out - np.log(-np.log(u)))], names)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns).mapInArrow(tidy(score), f"{kinds}, iw_log double, iw_key double"), held


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value, by narrowing a histogram until few values are left."""
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    if lo is None or k >= values.count():
        return -np.inf
    above = 0
    while True:
        inside = values.filter((F.col(column) >= lo) & (F.col(column) <= hi))
        if lo == hi:
            return lo
        step = (hi - lo) / 1024
        cell = F.when(F.col(column) >= hi, 1023).otherwise(F.least(F.floor((F.col(column) - lo) / step), F.lit(1023)))
        cells = {r.cell: r for r in inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()}
        for c in sorted(cells, reverse=True):
            if above + cells[c].n >= k:
                lo, hi = cells[c].a, cells[c].b
                break
            above += cells[c].n
        if k - above == 1:
            return hi


def thresholds(scored: DataFrame, held: np.ndarray, plan: Plan) -> float:
    """The k-th largest key: keys at least that are the sample."""
    spark = scored.sparkSession
    if plan.k is not None:
        return kth_largest(scored, "iw_key", plan.k) if plan.k > 0 else np.inf
    if not len(held):
        return -np.inf
    # at most plan.labelled doc_ids
    known = F.broadcast(spark.createDataFrame([(int(i),) for i in held], "held long"))
    weights = scored.join(known, F.col("doc_id") == F.col("held"), "left_semi")
    least = weights.agg(F.percentile("iw_log", plan.lost)).first()[0]
    if least is None:
        return -np.inf
    k = scored.filter(F.col("iw_log") >= least).count()
    return kth_largest(scored, "iw_key", max(1, k))


def resampled(docs: DataFrame, labels: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, log_weight, key, kept) for every row; kept: among the k largest keys, ties included.

    Null and blank texts have log weight 0 and are ranked like any other. Rows that repeat a doc_id share its
    noise; a null doc_id has the noise of -1. With neither k nor good labels every document is kept; an empty
    table gives no rows. Only doc_id and text, and the labels' doc_id and quality, are looked at.
    """
    scored, held = weighted(docs, labels, plan, ["doc_id", "text"])
    scored = stable(scored.select("doc_id", "iw_log", "iw_key"))
    least = thresholds(scored, held, plan)
    return scored.select("doc_id", F.col("iw_log").alias("log_weight"), F.col("iw_key").alias("key"), (F.col("iw_key") >= F.lit(float(least))).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of docs that the resampling draws, with docs' columns, whatever their names.

    Nulls, blank texts, repeated rows, ties and empty tables fare as in resampled().
    """
    columns = docs.columns
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(columns)])
    scored, held = weighted(plain, labels, plan)
    scored = stored(scored)
    least = thresholds(scored.select("doc_id", "iw_log", "iw_key"), held, plan)
    return scored.filter(F.col("iw_key") >= F.lit(float(least))).drop("iw_log", "iw_key").toDF(*columns)


def op10_quality_classifier(spark, sf_dir):
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
