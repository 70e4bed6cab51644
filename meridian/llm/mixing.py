"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in a keyed shuffled order, are laid end to end on a line of
words, twice (a mix may take every document two times), and cut into blocks of equally
many words. The schedule has one slot per block to take: slot k is the golden-ratio
point frac((k + 1/2) / phi), mapped through the sources' cumulative target shares, and a
slot's rank among its source's slots names the block it takes. Any stretch of the
schedule therefore holds each source near its share, and the mix is read in its order.

Offsets on the line are two-level prefix sums (buckets of a source, documents of a
bucket), so no source is gathered into one task. The slots are at most ``max_slots``;
blocks grow with the corpus instead. Whatever the blocks' size, each source is then
settled: blocks are added behind the schedule or left out at the source's end, and its
last one is cut, so that its words are its rounded target exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import MOST_KEYS, filtered, stable, table, words_of

# 1 / phi as a double.
INVERSE_PHI = 0.6180339887498949
BINS = 4096


def sized(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(rid, row, doc_id, source, size, spot): one row per document row; rid numbers the rows, row is a key that equal
    rows share (the column named, or a hash), spot the keyed shuffle position."""
    ident, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    return stable(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.xxhash64("doc_id", "source", "text").alias("row") if key is None else F.col(key).alias("row"),
            "doc_id",
            "source",
            F.size(words_of(F.col("text"))).cast("long").alias("size"),
            F.md5(F.concat(F.lit("mix-42:"), ident, F.lit(":"), F.md5(text))).alias("spot"),
        )
    )


def targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(sid, source, source_size, weight, target) by water filling: target = min(cap * size, level * weight).

    Sources go by code point, null last, and take the weights in turn. The level is the one at which the
    targets add up to ``share`` of all sizes; one row per source, so one task holds them.
    """
    line = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    each = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(line) - 1)
        .withColumn("weight", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    )
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    every = Window.partitionBy(F.lit(1))
    levels = (
        each.withColumn("filled", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("filled")) / F.col("open"))
        .withColumn("free", F.col("level") <= F.col("cap") / F.col("weight"))
    )
    level = F.coalesce(F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(every)["level"], F.lit(float("inf")))
    return levels.select("sid", "source", "source_size", "weight", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def schedule(goal: DataFrame, total: float, block: int) -> DataFrame:
    """(k, sid, rank): the source of slot k and its rank, from 0, among that source's slots."""
    spark = goal.sparkSession
    slots = int(total // block)
    up = Window.orderBy("sid")
    spans = (
        goal.filter("target > 0")
        .withColumn("hi", F.sum("target").over(up) / F.lit(total))
        .withColumn("lo", F.coalesce(F.lag("hi").over(up), F.lit(0.0)))
        .withColumn("hi", F.when(F.lead("sid").over(up).isNull(), F.lit(1.0)).otherwise(F.col("hi")))
        .select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * BINS), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS - 1)))).alias("bin"))
    )
    point = (F.col("id") + F.lit(0.5)) * F.lit(INVERSE_PHI)
    points = spark.range(slots).select(F.col("id").alias("k"), (point - F.floor(point)).alias("u")).withColumn("bin", F.floor(F.col("u") * BINS))
    chosen = points.join(spans, "bin").filter("u >= lo and u < hi")
    return chosen.select("k", "sid", (F.row_number().over(Window.partitionBy("sid").orderBy("k")) - 1).cast("long").alias("rank"))


def settled(slots: DataFrame, goal: DataFrame, block: int, n: int) -> DataFrame:
    """slots (k, sid, no) with as many blocks of each source as its rounded target needs; those that the n slots
    lack have numbers behind them, round by round of the sources."""
    slots = stable(slots)
    need = goal.select("sid", F.ceil(F.round("target") / F.lit(block)).alias("need"))
    have = slots.groupBy("sid").agg(F.count("*").alias("n"))
    missing = need.join(have, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < need")
    sources = goal.count()
    added = missing.select("sid", F.explode(F.sequence("n", F.col("need") - 1)).alias("no"))
    added = added.select((F.lit(n) + F.col("no") * sources + F.col("sid")).alias("k"), "sid", "no")
    return slots.join(need, "sid").filter("no < need").select("k", "sid", "no").unionByName(added)


def laid_out(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """Documents with ``at``, their first word's place on their source's line."""
    small = goal.select("sid", F.col("source").alias("g_source"), "source_size", "target")
    rows = sizes.join(F.broadcast(small) if goal_is_small(goal) else small, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    # some 65,536 documents a bucket, whatever their number
    digits = max(3, math.ceil(math.log(max(1, sizes.count()), 16)) - 4)
    rows = rows.withColumn("bucket", F.substring("spot", 1, digits))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("bucket_at"))
    inside = Window.partitionBy("sid", "bucket").orderBy("spot", "doc_id", "size", "row", "rid").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, ["sid", "bucket"]).withColumn("at", F.col("bucket_at") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def goal_is_small(goal: DataFrame, most: int = 50_000) -> bool:
    """One row per source; broadcast only while that many rows are few."""
    return goal.limit(most + 1).count() <= most


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, max_slots: int = 1 << 20, key: str | None = None) -> DataFrame:
    """(rid, row, doc_id, source, size, source_size, target, at, epochs, slots, taken).

    epochs: words taken on the first and the second pass over the line, of which taken is the sum; slots: the
    first slot of the schedule that takes them, null where a pass takes none. Null texts have size 0 and take
    nothing; a null source is a source; a null doc_id is shuffled as an empty one; repeated rows are documents
    of their own and follow each other; an empty table gives no rows. Columns other than doc_id, text and
    source (and key, a column that equal rows share) are not looked at.
    """
    sizes = sized(docs, key)
    goal = stable(targets(sizes, weights, share, cap))
    total = float(goal.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0])
    block = max(1, math.ceil(total / max_slots))
    slots = settled(schedule(goal, max(total, 1.0), block).select("k", "sid", F.col("rank").alias("no")), goal, block, int(max(total, 1.0) // block))
    placed = laid_out(sizes, goal)
    length, word, b = F.col("source_size"), F.col("size"), F.lit(block)

    def blocks(start):
        return F.when(word > 0, F.sequence(F.floor(start / b), F.floor((start + word - 1) / b)))

    parts = placed.withColumn("passes", F.array(F.struct(F.lit(0).alias("epoch"), F.col("at").alias("start")), F.struct(F.lit(1).alias("epoch"), (F.col("at") + length).alias("start"))))
    parts = parts.select("*", F.explode("passes").alias("p")).drop("passes")
    parts = parts.select("*", F.explode_outer(blocks(F.col("p.start"))).alias("no"))
    got = parts.join(slots, ["sid", "no"], "left")
    end = F.least(F.col("p.start") + word, (F.col("no") + 1) * b, F.round("target"))
    overlap = F.greatest(end - F.greatest(F.col("p.start"), F.col("no") * b), F.lit(0))
    words = lambda e: F.coalesce(F.sum(F.when(F.col("k").isNotNull() & (F.col("p.epoch") == e), overlap)), F.lit(0)).cast("long")
    slot = lambda e: F.min(F.when((F.col("p.epoch") == e) & (overlap > 0), F.col("k")))
    keys = ["rid", "row", "doc_id", "source", "size", "source_size", "target", "at"]
    out = got.groupBy(*keys).agg(words(0).alias("first"), words(1).alias("second"), F.array(slot(0), slot(1)).alias("slots"))
    return out.withColumn("epochs", F.array("first", "second")).withColumn("taken", F.col("first") + F.col("second")).drop("first", "second")


def mixed(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself, with docs' columns: a row for each pass over the line that takes words of a document.

    The rows are in the schedule's order, partition by partition, so any stretch of them holds each source near its
    share. A pass that takes a document in part has its first words, joined by single spaces; n_chars, where docs
    has it, follows the text. Documents of which nothing is taken are not in the mix, null and blank texts
    among them. Rows that repeat, wholly or in doc_id, source and text alone, are documents of their own with all
    their columns; columns may have any names. An empty table gives no rows.
    """
    columns = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    # two hashes of all columns tell rows apart; those that are equal in every column are one text and several plans
    whole = [F.to_json(at[f.name]) if "map" in f.dataType.simpleString() else F.col(at[f.name]) for f in docs.schema]
    plain = docs.toDF(*at.values())
    plain = plain.withColumn("mix_row", F.struct(F.xxhash64(*whole), F.xxhash64(F.lit(1), *whole[::-1])))
    plan = mix(plain.select(*[F.col(at[c]).alias(c) for c in ("doc_id", "source", "text")], "mix_row"), weights, share, cap, key="mix_row")
    plan = stable(plan.filter("taken > 0"))
    passes = F.explode(F.arrays_zip(F.col("epochs").alias("words"), F.col("slots").alias("slot")))
    parts = plan.select(F.col("row").alias("mix_row"), F.col("size").alias("mix_size"), "rid", "at", passes.alias("p"))
    parts = stable(parts.select("mix_row", "mix_size", "rid", "at", F.col("p.words").alias("mix_words"), F.col("p.slot").alias("mix_slot")).filter("mix_words > 0"))
    again = stable(plan.groupBy(F.col("row").alias("mix_row")).agg(F.count("*").alias("n")).filter("n > 1").select("mix_row"))
    if not again.isEmpty():
        once = filtered(plain, again, "mix_row", "left_semi").dropDuplicates(["mix_row"])
        plain = filtered(plain, again, "mix_row", "left_anti").unionByName(once)
    n, last = parts.agg(F.count("*"), F.max("mix_slot")).first()
    text = F.col(at["text"])
    cut = F.concat_ws(" ", F.slice(words_of(text), F.lit(1), F.col("mix_words").cast("int")))
    out = plain.join(F.broadcast(parts) if n <= MOST_KEYS // 2 else parts, "mix_row").withColumn(at["text"], F.when(F.col("mix_words") < F.col("mix_size"), cut).otherwise(text))
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.length(at["text"]).cast(docs.schema["n_chars"].dataType))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.least(F.floor(F.col("mix_slot") * tasks / F.lit((last or 0) + 1)), F.lit(tasks - 1)).cast("int")
    ordered = out.repartitionById(tasks, stretch).sortWithinPartitions("mix_slot", "at", "rid")
    return ordered.select(*at.values()).toDF(*columns)


def op8_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix-42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS spot
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1 AS sid FROM s0),
s2 AS (SELECT *, CASE sid % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
              sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free_w,
              sum(source_size) OVER () * 1.5::DOUBLE AS t FROM s2),
lv AS (SELECT arg_min((t - filled) / free_w, (cap / weight, sid)) AS level FROM s3 WHERE (t - filled) / free_w <= cap / weight),
goal AS (SELECT sid, source, source_size, least(cap, coalesce(level, 'inf'::DOUBLE) * weight) AS target FROM s3 LEFT JOIN lv ON true),
pl AS (SELECT d.doc_id, d.size, g.source_size, g.target, round(g.target) AS till,
              coalesce(sum(d.size) OVER (PARTITION BY g.sid ORDER BY spot, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
       FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(pos + size, till) - pos) + greatest(0, least(pos + source_size + size, till) - (pos + source_size)) AS BIGINT) AS taken
FROM pl
"""
