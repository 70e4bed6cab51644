"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``width`` consecutive words of one document. Its minimiser is the least hash
among the runs of ``m`` words inside it, so equal windows have equal minimisers, and
neighbouring windows mostly share one. Consecutive windows with the same minimiser
travel as one packed string to the minimiser's bucket; there all windows are sorted by a
rolling hash and neighbours are compared word for word, so counts are exact.

Three things keep a popular passage from filling a bucket. Word runs that are frequent in
a bounded sample rank last as minimisers, so windows that only touch the passage go where
their other words send them (this moves work, never results). A string that a task sees
twice needs no bucket to know that its windows repeat: its places are settled at once,
and one copy without places goes on. And strings travel compressed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import table, tidy
from meridian.llm.words import ODD, Words, mix, normal

WIDTH = 35
M = 3
#: Bytes of text that a task packs at once.
PACK_BYTES = 4 << 20
#: Least documents of the sample that tells frequent word runs, and the sampled documents that make a run frequent.
SAMPLE_DOCS = 8_000
FREQUENT = 6
MOST_FREQUENT = 1 << 16
#: Text whose windows come to a bucket, and to a partition of buckets, on the average, at most.
BUCKET_BYTES = 8 << 20
PART_BYTES = 256 << 20
#: Of zstandard, for strings and texts that are shuffled.
LEVEL = 6
NO_ID = -(1 << 63)

def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of values[i : i + span] at i, by doubling; short at the end."""
    out, done = values, 1
    while done < span:
        step = min(done, span - done)
        nxt = out.copy()
        np.minimum(out[: len(out) - step], out[step:], out=nxt[: len(out) - step])
        out, done = nxt, done + step
    return out


def _minimisers(words: Words, at: np.ndarray, width: int, frequent: np.ndarray) -> np.ndarray:
    """The minimiser of each window: frequent word runs rank after all others."""
    grams = words.runs(M)
    low = grams >> np.uint64(1)
    if len(frequent):
        near = np.zeros(1 << 16, bool)
        near[(frequent & np.uint64(0xFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(near[(grams & np.uint64(0xFFFF)).astype(np.int64)])
        found = maybe[np.isin(grams[maybe], frequent)]
        low[found] |= np.uint64(1 << 63)
    return _least(low, width - M + 1)[at] if len(at) else np.empty(0, np.uint64)


def pack(lines: list[bytes], doc: np.ndarray, key: np.ndarray, width: int, buckets: int, frequent: np.ndarray):
    """Per bucket the packed strings of some documents, then the places settled here.

    Yields (bucket, blob, doc bytes, key bytes, start bytes, last bytes): for a string, start is its first
    window's first word, or -1 if its places are settled; without a blob, start to last are settled windows.
    """
    words = Words(lines)
    at, line = words.windows(width)
    if not len(at):
        return
    least = _minimisers(words, at, width, frequent)
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (line[1:] != line[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    begin = words.starts[at[first]].tolist()
    end = words.ends[at[last] + width - 1].tolist()
    buf = words.buf
    strings = [buf[b:e] for b, e in zip(begin, end, strict=True)]
    seen: dict[bytes, int] = {}
    mate = np.fromiter((seen.setdefault(s, i) for i, s in enumerate(strings)), np.int64, len(strings))
    often = np.bincount(mate, minlength=len(strings)) > 1
    place = at[first] - words.first[line[first]]
    upto = place + (last - first)
    owner = line[first]
    settled = np.flatnonzero(often[mate])
    unique = np.flatnonzero(mate == np.arange(len(strings)))
    bucket = (mix(least[first[unique]]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    unique, bucket = unique[order], bucket[order]
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(bucket)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        these = unique[lo:hi]
        start = np.where(often[these], -1, place[these]).astype(np.int32)
        blob = squeeze.compress(b"\n".join([strings[i] for i in these.tolist()]))
        yield int(bucket[lo]), blob, doc[owner[these]].tobytes(), key[owner[these]].tobytes(), start.tobytes(), None
    if len(settled):
        spread = int(abs(int(key[owner[settled[0]]]))) % buckets
        yield spread, None, doc[owner[settled]].tobytes(), key[owner[settled]].tobytes(), place[settled].astype(np.int32).tobytes(), upto[settled].astype(np.int32).tobytes()


def repeated(blobs: list[bytes], doc: np.ndarray, key: np.ndarray, start: np.ndarray, width: int):
    """(doc, key, first window, last window) of runs of repeated windows among a bucket's strings."""
    expand = zstandard.ZstdDecompressor()
    words = Words(b"\n".join([expand.decompress(b) for b in blobs]).split(b"\n"))
    at, line = words.windows(width)
    power = np.empty(len(words.hash) + 1, np.uint64)
    power[0] = 1
    power[1:] = ODD
    np.multiply.accumulate(power, out=power)
    back = np.empty(len(words.hash) + 1, np.uint64)
    back[0] = 1
    back[1:] = np.uint64(pow(int(ODD), -1, 1 << 64))
    np.multiply.accumulate(back, out=back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * power[:-1], dtype=np.uint64)])
    rolled = mix((sums[at + width] - sums[at]) * back[at])
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    again = start[line] < 0
    if len(same):
        begin, end = words.starts[at], words.ends[at + width - 1]
        left, right = order[same], order[same + 1]
        buf = words.buf
        spans = zip(begin[left].tolist(), end[left].tolist(), begin[right].tolist(), end[right].tolist(), strict=True)
        equal = np.fromiter((buf[a:b] == buf[c:d] for a, b, c, d in spans), bool, len(same))
        again[left[equal]] = True
        again[right[equal]] = True
        if not equal.all():  # other windows share the hash: compare all of that hash
            for value in np.unique(ranked[same[~equal]]):
                lo, hi = np.searchsorted(ranked, value), np.searchsorted(ranked, value, "right")
                met: dict[bytes, int] = {}
                for w in order[lo:hi].tolist():
                    if (mate := met.setdefault(buf[begin[w] : end[w]], w)) != w:
                        again[mate] = again[w] = True
    told = np.flatnonzero(again & (start[line] >= 0))
    if not len(told):
        return doc[:0], key[:0], start[:0], start[:0]
    ahead = np.concatenate([[True], (told[1:] != told[:-1] + 1) | (line[told[1:]] != line[told[:-1]])])
    cut = np.flatnonzero(ahead)
    lo, hi = told[cut], told[np.concatenate([cut[1:], [len(told)]]) - 1]
    of = line[lo]
    shift = start[of].astype(np.int64) - words.first[of]
    return doc[of], key[of], (at[lo] + shift).astype(np.int32), (at[hi] + shift).astype(np.int32)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, key, text): key is the text's hash, so that rows which share a doc_id stay apart unless they are equal."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))


def frequent_runs(keyed: DataFrame, n: int) -> np.ndarray:
    """Hashes of word runs that some documents of a sample of the n hold.

    The sample grows with the square root of n, so what it misses is in so few documents that a bucket stays small
    (of 10^10 documents, in some 40,000); the runs are bounded by MOST_FREQUENT.
    """
    sample = max(SAMPLE_DOCS, 16 * math.isqrt(n))
    if not n:
        return np.empty(0, np.uint64)
    share = int(min(1.0, sample / n) * (1 << 30))
    some = keyed.filter(F.pmod(F.xxhash64(F.lit(7), "doc", "key"), F.lit(1 << 30)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                w = Words([normal(t.as_py())])
                grams = np.unique(w.runs(M)[: max(0, len(w.hash) - M + 1)])
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    counts = some.select("text").mapInArrow(tidy(run), "gram long").groupBy("gram").agg(F.count("*").alias("n"))
    rows = counts.filter(F.col("n") >= FREQUENT).orderBy(F.col("n").desc(), "gram").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r.gram for r in rows], np.int64).view(np.uint64))


def repeats(keyed: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, key, lo, hi): runs of windows, by first word, whose word sequence starts elsewhere too."""
    spark = keyed.sparkSession
    n, size = keyed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # a task holds a bucket at a time: there are as many as keep it small, whatever the number of partitions
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    buckets = max(4 * parts, size // BUCKET_BYTES)
    frequent = frequent_runs(keyed, n)
    strings = "bucket int, blob binary, doc binary, key binary, start binary, last binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(lines, doc, key):
            rows = list(pack(lines, np.array(doc, np.int64), np.array(key, np.int64), width, buckets, frequent))
            names = [x.split()[0] for x in strings.split(", ")]
            kinds = [pa.int32()] + [pa.binary()] * 5
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 64], strict=True), kinds, strict=True)], names)

        lines, doc, key, size = [], [], [], 0
        for b in batches:
            for d, k, t in zip(b.column("doc").to_pylist(), b.column("key").to_pylist(), b.column("text"), strict=True):
                line = normal(t.as_py())
                lines.append(line)
                doc.append(d)
                key.append(k)
                size += len(line)
                if size >= PACK_BYTES:
                    yield from packed(lines, doc, key)
                    lines, doc, key, size = [], [], [], 0
        if lines:
            yield from packed(lines, doc, key)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "key", "lo", "hi"]
        now, held = None, []

        def counted():
            cols = [np.frombuffer(b"".join(r[i] for r in held), t) for i, t in ((1, np.int64), (2, np.int64), (3, np.int32))]
            return pa.RecordBatch.from_arrays([pa.array(a) for a in repeated([r[0] for r in held], *cols, width)], names)

        # a few rows at a time, or all blobs of a batch would be held twice
        for b in (batch.slice(at, 128) for batch in batches for at in range(0, batch.num_rows, 128)):
            for bucket, *row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if row[0] is None:
                    cols = [np.frombuffer(x, t) for x, t in zip(row[1:], (np.int64, np.int64, np.int32, np.int32), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in cols], names)
                    continue
                if bucket != now and held:
                    yield counted()
                    held = []
                now = bucket
                held.append(row)
        if held:
            yield counted()

    dealt = keyed.mapInArrow(tidy(cut), strings).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(count), "doc long, key long, lo int, hi int")


def removed(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 and, if asked, text): the kept words joined by one space.

    Every word inside a window that starts at least twice in the table goes, all copies alike. Null and blank
    texts have no words. Rows that repeat are windows of their own, so both lose what they share. A null
    doc_id stays null. An empty table gives no rows; columns other than doc_id and text are not looked at.
    """
    keyed = _keyed(docs)
    spans = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))
    found = repeats(keyed, width).groupBy("doc", "key").agg(F.collect_set(spans).alias("spans"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("key"), pa.array([pack.compress(normal(t.as_py())) for t in b.column("text")], pa.binary())], ["doc", "key", "text"])

    small = keyed.mapInArrow(tidy(squeeze), "doc long, key long, text binary")
    rows = small.join(found.hint("shuffle_hash"), ["doc", "key"], "left").select("doc", "text", "spans")
    schema = "doc long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for doc, text, span in zip(b.column("doc").to_pylist(), b.column("text"), b.column("spans").to_pylist(), strict=True):
                words = expand.decompress(text.as_py()).split()
                n = len(words)
                if span:
                    edge = np.zeros(n + 1, np.int64)
                    packed = np.array(span, np.int64)
                    np.add.at(edge, packed >> 32, 1)
                    np.add.at(edge, (packed & 0xFFFFFFFF) + width, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:n] == 0).tolist()]
                kept = b" ".join(words)
                out.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode())[: 4 + with_text])
            names = ["doc", "n_words", "n_removed", "kept_sha256", "text"][: 4 + with_text]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)] if out else [pa.array([], k) for k in kinds[: len(names)]], names)

    made = rows.mapInArrow(tidy(run), schema)
    return made.withColumn("doc_id", F.when(F.col("doc") != NO_ID, F.col("doc"))).select("doc_id", *[c for c in made.columns if c != "doc"])


def op6_substring_dedup(spark, sf_dir):
    return removed(table(spark, sf_dir, "documents"), with_text=False)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS rid FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d)),
rep AS (SELECT rid, i FROM win SEMI JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS pos FROM rep),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY pos) AS text FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) x ANTI JOIN gone USING (rid, pos) GROUP BY rid),
cut AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (rid) LEFT JOIN kept USING (rid)
"""
