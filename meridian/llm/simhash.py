"""SimHash near-duplicates by a binary trie self-join.

Two fingerprints that differ in at most ``budget`` of 64 bits agree in at least one of
``budget + 1`` blocks, so each distinct fingerprint is dealt once per block by that
block's value, rotated to the front. Within a deal the fingerprints form a binary trie
(a sorted array; a node is a range of it), which is joined with itself: node pairs go
down together bit by bit, differing bits add up, and a pair over the budget is pruned.
A deal with too many fingerprints is split by its next bits into pairs of sub-tries,
again only those within the budget.

Copies share a fingerprint and are joined once; links become the stars of local
components before they leave a task, so a group of thousands sends no pair list.

Near-duplicates by shingle similarity take several shorter SimHashes and trie joins of
each. What those connect are clusters of candidates, in which every pair is compared
exactly: a cluster is one block of shingle sets or several, and a task takes two blocks and
gives back the links of local components, never the pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import filtered, released, stable, stored, table, tidy
from meridian.llm.components import components, unite
from meridian.llm.words import ODD, mix

BITS = 64
UPPER_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Distinct fingerprints of one block value that a task joins as one trie.
MOST_IN_TRIE = 20_000
#: Rows, and node pairs, that a task holds at once.
BUFFER = 100_000
FRONTIER = 100_000
#: Numbers of tables after which what is connected so far is found, before the others.
TABLES_UNTIL = (2,)
#: Shingle sets that a task compares with as many others, and their bytes.
BLOCK = 1024
BLOCK_BYTES = 32 << 20
#: Sets from which a shingle is counted by matrix products instead of pair by pair.
COMMON = 48
#: Pairs of sets that are counted at once.
PAIRS = 400_000


# ---- fingerprints


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The SimHash of the text's word shingles by XXH64 (seed 42); 0 for a text without words."""
    words = (text or b"").translate(UPPER_TO_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    ends = (starts[min(width, len(words)) :] - 1)[:n].tolist()
    starts = starts[:n].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 32768):
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at : at + 32768], ends[at : at + 32768], strict=True)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint for every row, from its whole text.

    Null and blank texts have 0; repeated rows have one each; an empty table gives no rows. Only doc_id and text
    are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, fp long")


# ---- the trie self-join


def join_tries(keys: np.ndarray, roots: list[np.ndarray], budget: int, first_bit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys (uint64, sorted within each root's ranges) that differ in at most budget bits.

    roots: arrays xlo, xhi, ylo, yhi of node pairs whose keys agree above first_bit; x and y are the same
    node or disjoint ones.
    """
    todo = [(first_bit, *roots, np.zeros(len(roots[0]), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while todo:
        bit, xlo, xhi, ylo, yhi, err = todo.pop()
        if len(xlo) > FRONTIER:
            half = len(xlo) // 2
            todo += [(bit, *(a[:half] for a in (xlo, xhi, ylo, yhi, err))), (bit, *(a[half:] for a in (xlo, xhi, ylo, yhi, err)))]
            continue
        small = (xhi - xlo) * (yhi - ylo) <= 16
        if bit == BITS:
            small[:] = True
        if small.any():  # few enough keys below: compare them, whatever is left of the budget
            i, j = _expand(xlo[small], xhi[small], ylo[small], yhi[small])
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            near &= i != j
            if near.any():
                yield i[near], j[near]
        big = ~small
        if not big.any():
            continue
        xlo, xhi, ylo, yhi, err = (a[big] for a in (xlo, xhi, ylo, yhi, err))
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((keys >> np.uint64(BITS - 1 - bit)) & np.uint64(1), dtype=np.int64)])
        c = ones[bit]
        xmid, ymid = xhi - (c[xhi] - c[xlo]), yhi - (c[yhi] - c[ylo])
        cross = xlo != ylo
        parts = [(xlo, xmid, ylo, ymid, err), (xmid, xhi, ymid, yhi, err), (xlo, xmid, ymid, yhi, err + 1), tuple(a[cross] for a in (xmid, xhi, ylo, ymid, err + 1))]
        new = [np.concatenate(a) for a in zip(*parts, strict=True)]
        keep = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= budget)
        if keep.any():
            todo.append((bit + 1, *(a[keep] for a in new)))


def _expand(xlo, xhi, ylo, yhi):
    wide = yhi - ylo
    n = (xhi - xlo) * wide
    pair = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    return xlo[pair] + k // wide[pair], ylo[pair] + k % wide[pair]


def _local_links(rows: dict[str, np.ndarray], budget: int, most_apart: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Links (u, v) that connect the components within some whole deals: stars, or with most_apart pairs whose check
    words differ in no more bits than that, the closest first, a forest over what ``group`` says is connected already,
    and the groups of both."""
    order = np.lexsort((rows["key"], rows["side"], rows["deal"]))
    keys, head, deal, side = (rows[c][order] for c in ("key", "head", "deal", "side"))
    new = np.concatenate([[True], (deal[1:] != deal[:-1]) | (side[1:] != side[:-1])])
    lo = np.flatnonzero(new)
    hi = np.concatenate([lo[1:], [len(keys)]])
    split = rows["split"][order][lo]  # 1: the deal joins side 0 with side 1; 0: side 0 with itself
    own = split == 0
    mates = np.flatnonzero((split[:-1] == 1) & (deal[lo[:-1]] == deal[lo[1:]])) if len(lo) > 1 else np.empty(0, np.int64)
    roots = [np.concatenate(x) for x in ((lo[own], lo[mates]), (hi[own], hi[mates]), (lo[own], lo[mates + 1]), (hi[own], hi[mates + 1]))]
    parent = np.arange(len(keys))
    if most_apart is None:
        for i, j in join_tries(keys, roots, budget, 0):
            parent = unite(parent, i, j)
        moved = np.flatnonzero(parent != np.arange(len(keys)))
        yield head[moved], head[parent[moved]]
        return
    group = rows["group"][order]
    _, first, of = np.unique(group, return_index=True, return_inverse=True)
    parent = first[of]
    check = [rows[c][order].view(np.uint64) for c in ("check", "check2")]
    for i, j in join_tries(keys, roots, budget, 0):
        apart = sum(np.bitwise_count(c[i] ^ c[j]).astype(np.int64) for c in check)
        near = np.flatnonzero((apart <= most_apart) & (parent[i] != parent[j]))
        near = near[np.argsort(apart[near], kind="stable")]
        while len(near):  # the closest pair of each component, then of those that are apart still
            _, first = np.unique(np.stack([parent[i[near]], parent[j[near]]], axis=1).ravel(), return_index=True)
            here = near[np.unique(first // 2)]
            yield head[i[here]], head[j[here]], group[i[here]], group[j[here]]
            parent = unite(parent, i[here], j[here])
            near = near[parent[i[near]] != parent[j[near]]]


def links(heads: DataFrame, budget: int = 3, most: int = MOST_IN_TRIE, width: int = BITS, most_apart: int | None = None) -> DataFrame:
    """(u, v): links that connect all of heads (fp, head) within budget differing bits, as a forest or little more.

    fp holds width bits. With most_apart, heads also has ``table`` (fingerprints of different tables do not
    meet), ``check`` and ``check2``, 128 further bits of which a link may differ in most_apart, and ``group``: heads of
    one group are connected already and no link between them is needed; links have the groups that they connect,
    group_u and group_v, in order. Of equal fp there
    should be one head, as only one is linked on; no heads give no rows. A deal is split by twelve bits at most,
    which keeps tries small up to some 80 million fingerprints of one block value.
    """
    blocks = budget + 1
    bits = width // blocks
    mask = (1 << width) - 1 if width < BITS else -1
    turn = lambda k: F.shiftleft("fp", k).bitwiseOR(F.shiftrightunsigned("fp", width - k)).bitwiseAND(F.lit(mask)) if k else F.col("fp")
    rotated = lambda k: F.shiftleft(turn(k), BITS - width) if width < BITS else turn(k)
    carried = ["head"] if most_apart is None else ["head", "check", "check2", "group"]
    table = F.lit(0) if most_apart is None else F.col("table")
    turned = heads.select(*carried, table.alias("table"), F.posexplode(F.array(*[rotated(bits * k) for k in range(blocks)])).alias("turn", "key"))
    turned = turned.withColumn("deal", (F.shiftrightunsigned("key", BITS - bits) * 1024 + F.col("table")) * blocks + F.col("turn")).drop("table", "turn")
    large = turned.groupBy("deal").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    # A large deal is split by its next bits; sub-tries go to a deal for each pair within the budget.
    extra = F.least(F.lit(12), F.ceil(F.log2(F.col("n") / most)) + 1).cast("int")
    # at most blocks * 2^bits deals in each table, a few MB
    sized = turned.join(F.broadcast(large.select("deal", extra.alias("extra"))), "deal", "left")
    usual = sized.filter("extra is null").select("deal", "key", *carried, F.lit(0).alias("side"), F.lit(0).alias("split"))
    flips = [sum(1 << b for b in chosen) for n in range(budget + 1) for chosen in itertools.combinations(range(12), n)]
    sub = F.expr(f"shiftrightunsigned(key, {BITS - bits} - extra) & (shiftleft(1L, extra) - 1)")
    pairs = (
        sized.filter("extra is not null")
        .withColumn("sub", sub)
        .withColumn("flip", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])))
        .filter("flip < shiftleft(1L, extra)")
        .withColumn("mate", F.expr("sub ^ flip"))
        .select(F.expr("xxhash64(deal, least(sub, mate), greatest(sub, mate))").alias("deal"), "key", *carried, F.expr("cast(sub > mate as int)").alias("side"), F.expr("cast(sub != mate as int)").alias("split"))
    )
    dealt = usual.unionByName(pairs)
    spark = heads.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "deal").sortWithinPartitions("deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def joined(rows: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for u, v, *groups in _local_links({c: np.concatenate([r[c] for r in rows]) for c in rows[0]}, budget, most_apart):
                ends = [np.maximum(u, v), np.minimum(u, v), *((np.maximum(*groups), np.minimum(*groups)) if groups else ())]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["u", "v", "group_u", "group_v"][: len(ends)])

        for b in batches:
            rows = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
            rows["key"] = rows["key"].astype(np.int64).view(np.uint64)
            if not len(rows["deal"]):
                continue
            held.append(rows)
            if sum(len(r["deal"]) for r in held) < BUFFER or held[0]["deal"][0] == rows["deal"][-1]:
                continue
            # the last deal may go on in the next batch
            rows = {c: np.concatenate([r[c] for r in held]) for c in held[0]}
            whole = int(np.searchsorted(rows["deal"], rows["deal"][-1]))
            held = [{c: a[whole:] for c, a in rows.items()}]
            if whole:
                yield from joined([{c: a[:whole] for c, a in rows.items()}])
        if held:
            yield from joined(held)

    return dealt.mapInArrow(tidy(run), "u long, v long" if most_apart is None else "u long, v long, group_u long, group_v long")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable over links.

    Null and blank texts have fingerprint 0 and link like any other. Rows that repeat a doc_id are linked
    each by its own text. Rows with a null doc_id have a fingerprint and a null component_id, and link
    nothing. An empty table gives no rows; columns other than doc_id and text are not looked at.
    """
    fps = stable(fingerprints(docs, width))
    heads = stable(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").cast("long").alias("head")))
    roots = components(links(heads, budget))
    named = heads.join(roots, F.col("head") == F.col("node"), "left").select("fp", F.coalesce("root", "head").alias("component_id"))
    out = fps.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# ---- near-duplicates by shingle similarity


@dataclass(frozen=True)
class Plan:
    """width: words of a shingle; similarity: Jaccard similarity of two documents' shingle sets from which they
    are near-duplicates; tables, bits, budget: SimHashes per document, their length, and the bits in which a
    candidate pair may differ in one of them; most_apart: bits of a further 128 in which it may differ (4.5
    deviations more than pairs with similarity 0.8 do, and as many less than unlike ones).

    Shingle sets with similarity 0.8 differ in a SimHash bit with probability 0.15, so one table of 32 bits and
    a budget of 3 finds 27 % of such pairs, sixteen 99.3 %; of pairs from 0.85 on they find 99.98 %.
    """

    width: int = 5
    similarity: float = 0.8
    tables: int = 16
    bits: int = 32
    budget: int = 3
    most_apart: int = 38


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Distinct XXH64 hashes of the text's word shingles; a text with fewer words has one shingle, none has none."""
    words = (text or b"").translate(UPPER_TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    ends = (starts[min(width, len(words)) :] - 1)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends, strict=True)], np.uint64))


def sketch(shingles: np.ndarray, plan: Plan) -> bytes:
    """Majority bits of the set: plan.tables SimHashes, then 128 bits to check; zeros for an empty set."""
    words = -(-plan.tables * plan.bits // BITS) + 2
    if not len(shingles):
        return bytes(8 * words)
    ones = np.zeros(BITS * words, np.int64)
    for at in range(0, len(shingles), 8192):
        h = shingles[at : at + 8192]
        many = np.stack([mix(h + np.uint64(k * int(ODD) & 0xFFFFFFFFFFFFFFFF)) for k in range(words)], axis=1).astype(">u8")
        ones += np.unpackbits(many.view(np.uint8).reshape(len(h), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def _named(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ... and sh_row, a key of doc_id and text; equal rows share it."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    ident, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    return plain.withColumn("sh_row", F.xxhash64(ident, text))


def similar_links(rows: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """rows: (sh_row, doc_id, text). Returns (sh_row, doc_id, head), head being the first row with the same sketch,
    and (u, v): links that connect heads whose shingle sets reach the similarity, and no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sketch(shingle_set(t.as_py(), plan.width), plan) for t in b.column(2)], pa.binary())], ["sh_row", "doc_id", "sketch"])

    texts = rows.select("sh_row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sketched = stable(texts.mapInArrow(tidy(run), "sh_row long, doc_id long, sketch binary"))
    heads = stable(sketched.groupBy("sketch").agg(F.min("sh_row").alias("head")))
    members = sketched.join(heads, "sketch").select("sh_row", "doc_id", "head")

    def tables(rows: DataFrame, which: range) -> DataFrame:
        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                raw = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u4").reshape(b.num_rows, -1)
                check = np.ascontiguousarray(raw[:, -4:]).view(">u8").astype(np.int64)
                for k in which:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw[:, k].astype(np.int64)), pa.array(check[:, 0].copy()), pa.array(check[:, 1].copy()), pa.array(np.full(b.num_rows, k, np.int32)), b.column(2)], ["head", "fp", "check", "check2", "table", "group"])

        return rows.select("head", "sketch", "group").mapInArrow(tidy(spread), "head long, fp long, check long, check2 long, table int, group long")

    def near(rows: DataFrame, which: range) -> DataFrame:
        every = links(tables(rows, which), plan.budget, MOST_IN_TRIE, plan.bits, plan.most_apart)
        return stable(every.groupBy("group_u", "group_v").agg(F.min(F.struct("u", "v")).alias("link")).select("group_u", "group_v", "link.*"))

    # A large group would be linked on in every deal of every table: what the tables before connect needs no further
    # link, and two groups need one.
    known, found, roots, start = heads.withColumn("group", F.col("head")), None, None, 0
    for end in [*(n for n in TABLES_UNTIL if n < plan.tables), plan.tables]:
        new = near(known, range(start, end))
        pairs = new.select(F.col("group_u").alias("u"), F.col("group_v").alias("v"))
        roots = components(pairs if roots is None else roots.toDF("u", "v").unionByName(pairs))
        known = heads.join(roots, F.col("head") == F.col("node"), "left").select("head", "sketch", F.coalesce("root", "head").alias("group"))
        found, start = new.select("u", "v") if found is None else found.unionByName(new.select("u", "v")), end
    released(rows.sparkSession)
    return members, compared(texts, found, roots, plan)


def shingle_sets(texts: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """(head, shingles, size) of the rows that nodes names."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py(), plan.width).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), pa.array([len(x) for x in found], pa.int64())], ["head", "shingles", "size"])

    some = filtered(texts, nodes.select(F.col("head").alias("sh_row")), "sh_row", "left_semi").dropDuplicates(["sh_row"])
    return some.select("sh_row", "text").mapInArrow(tidy(sets), "head long, shingles binary, size long")


def compared(texts: DataFrame, found: DataFrame, roots: DataFrame, plan: Plan) -> DataFrame:
    """(u, v): links that connect what has the similarity among the clusters roots (node, root) that the candidates
    found (u, v) connect.

    In a cluster of more than a block, one candidate of each document is verified first, so that most of a large group
    of near-duplicates is one before blocks meet; blocks within such a group need not meet.
    """
    nodes = stable(roots.select(F.col("node").alias("head"), F.col("root").alias("cluster")).unionByName(roots.select(F.col("root").alias("head"), F.col("root").alias("cluster")).distinct()))
    sets = stored(shingle_sets(texts, nodes, plan))
    sized = stable(nodes.join(sets.select("head", "size"), "head"))
    whole = sized.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    wide = stable(whole.filter((F.col("n") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).select("cluster"))
    grouped, first = sized.withColumn("group", F.col("head")), None
    if not wide.isEmpty():
        inner = stable(filtered(sized, wide, "cluster", "left_semi").select("head"))
        some = filtered(found.withColumnRenamed("u", "head"), inner, "head", "left_semi")
        first = stable(verified(sets, some.groupBy(F.col("head").alias("u")).agg(F.min("v").alias("v")), plan))
        released(texts.sparkSession)
        joined = components(first)
        grouped = sized.join(joined, F.col("head") == F.col("node"), "left").withColumn("group", F.coalesce("root", "head")).drop("node", "root")
        grouped = stable(grouped)
    links_ = in_blocks(grouped, sets, plan)
    return stable(links_ if first is None else links_.unionByName(first))


def verified(sets: DataFrame, found: DataFrame, plan: Plan) -> DataFrame:
    """Those of found (u, v) whose shingle sets have the similarity."""
    named = lambda head, set_: sets.select(F.col("head").alias(head), F.col("shingles").alias(set_))
    pairs = found.join(named("u", "a"), "u").join(named("v", "b"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for a, c in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= plan.similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "a", "b").mapInArrow(tidy(run), "u long, v long")


def in_blocks(rows: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """(u, v): links that connect what has the similarity within each cluster of rows (head, cluster, group, size).

    Groups are connected already. A group of more than a block has blocks of its own, which need not meet each
    other; the other groups of a cluster share blocks. Clusters of one group are left out.
    """
    groups = rows.groupBy("cluster", "group").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    many = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES, F.lit(1e-9)))
    groups = stable(groups.withColumn("own", many))
    several = groups.groupBy("cluster").agg(F.count("*").alias("groups")).filter("groups > 1").select("cluster")
    groups = stable(groups.join(several, "cluster", "left_semi"))
    shared = groups.filter("own = 1").groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).withColumn("of", many)
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("k")
    blocks = shared.select("cluster", F.lit(None).cast("long").alias("of_group"), span("of"))
    blocks = stable(blocks.unionByName(groups.filter("own > 1").select("cluster", F.col("group").alias("of_group"), span("own"))))
    # every two blocks of a cluster meet in a cell, but for those of one group; a cluster of one block has one cell
    mate = blocks.withColumnsRenamed({"of_group": "of_group2", "k": "k2"})
    order = F.struct(F.coalesce("of_group2", F.lit(-(1 << 63))), "k2") >= F.struct(F.coalesce("of_group", F.lit(-(1 << 63))), "k")
    cells = blocks.join(mate, "cluster").filter(order & ~F.coalesce(F.col("of_group") == F.col("of_group2"), F.lit(False)))
    cells = cells.withColumn("cell", F.xxhash64("cluster", "of_group", "k", "of_group2", "k2"))
    same = F.col("of_group").isNull() & F.col("of_group2").isNull() & (F.col("k") == F.col("k2"))
    ends = cells.select("cluster", "of_group", "k", "cell", F.lit(0).alias("side")).unionByName(cells.filter(~same).select("cluster", F.col("of_group2").alias("of_group"), F.col("k2").alias("k"), "cell", F.lit(1).alias("side")))
    place = rows.join(groups.select("cluster", "group", "own"), ["cluster", "group"]).join(shared.select("cluster", "of"), "cluster", "left")
    block = F.when(F.col("own") > 1, F.pmod(F.xxhash64("head"), "own")).otherwise(F.pmod(F.xxhash64("group"), "of"))
    place = place.select("cluster", F.when(F.col("own") > 1, F.col("group")).alias("of_group"), block.alias("k"), "head", "group")
    on = (F.col("p.cluster") == F.col("e.cluster")) & F.col("p.k").eqNullSafe(F.col("e.k")) & F.col("p.of_group").eqNullSafe(F.col("e.of_group"))
    placed = place.alias("p").join(ends.alias("e"), on).select("e.cell", "e.side", "p.head", "p.group")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.join(sets.select("head", "shingles"), "head").repartition(parts, "cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for cell, *row in zip(*(b.column(c).to_pylist() for c in ("cell", "side", "head", "group", "shingles")), strict=True):
                if cell != now and held:
                    yield met(held, plan.similarity)
                    held = []
                now = cell
                held.append(row)
        if held:
            yield met(held, plan.similarity)

    return dealt.select("cell", "side", "head", "group", "shingles").mapInArrow(tidy(run), "u long, v long")


def met(rows: list[tuple], similarity: float) -> pa.RecordBatch:
    """Links (u, v) that connect what has the similarity across the sides of a cell, or within its only side."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    side, head, group = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    both = shared_shingles([np.frombuffer(r[3], np.uint64) for r in rows], side)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    size = np.array([len(r[3]) // 8 for r in rows], np.int64)
    _, first, of = np.unique(group, return_index=True, return_inverse=True)
    parent = first[of]
    for at in range(0, len(left), 64):
        some = left[at : at + 64]
        near = both[at : at + 64] >= similarity * (size[some][:, None] + size[right][None, :] - both[at : at + 64])
        i, j = np.nonzero(near & (parent[some][:, None] != parent[right][None, :]))
        parent = unite(parent, some[i], right[j])
    # what a group's first row here is linked to, the group is
    moved = np.flatnonzero((parent != np.arange(len(rows))) & (group != group[parent]))
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(head[moved], head[parent[moved]])), pa.array(np.minimum(head[moved], head[parent[moved]]))], ["u", "v"])


def shared_shingles(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """How many shingles sets of side 0 and of side 1 share, [left, right]; of side 0 and itself if there is no other
    (a set's count with itself lacks what it alone holds).

    Shingles of few sets are counted pair by pair, those of many by products of 0/1 matrices.
    """
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    n = np.diff(np.append(start, len(values)))
    rows, cols = len(left), len(left) if alone else len(right)
    out = np.zeros((rows, cols), np.float32)
    place = np.zeros(len(sets), np.int64)
    place[left] = np.arange(len(left))
    place[right] = np.arange(len(right))
    few = np.flatnonzero((n > 1) & (n < COMMON))
    for some in np.split(few, np.flatnonzero(np.diff(np.cumsum(n[few] ** 2) // PAIRS)) + 1):
        s, m = start[some], n[some]
        i, j = _expand(s, s + m, s, s + m)
        a, b = owner[i], owner[j]
        fits = (side[a] == 0) & ((side[b] == 1) | alone)
        out += np.bincount(place[a[fits]] * cols + place[b[fits]], minlength=rows * cols).reshape(rows, cols).astype(np.float32)
    common = np.flatnonzero(n >= COMMON)
    for at in range(0, len(common), 1024):
        some = common[at : at + 1024]
        m = n[some]
        column = np.repeat(np.arange(len(some)), m)
        of = owner[np.repeat(start[some] - np.cumsum(m) + m, m) + np.arange(m.sum())]
        x = np.zeros((rows, len(some)), np.float32)
        y = x if alone else np.zeros((cols, len(some)), np.float32)
        here = side[of] == 0
        x[place[of[here]], column[here]] = 1
        if not alone:
            y[place[of[~here]], column[~here]] = 1
        out += x @ y.T
    return out


def one_of_each(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """docs with one row of each group of near-duplicates, the one with the smallest doc_id (null last).

    Groups are what links of the similarity connect. Texts without words are one group; a null doc_id is
    larger than any; equal rows are one. An empty table gives no rows; all columns are carried along.
    """
    rows = _named(docs)
    ident, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    members, near = similar_links(rows.select("sh_row", F.col(ident).alias("doc_id"), F.col(text).alias("text")), plan)
    roots = components(near)
    grouped = members.join(roots, F.col("head") == F.col("node"), "left").withColumn("root", F.coalesce("root", "head"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sh_row"))["sh_row"]
    stay = grouped.groupBy("root").agg(first.alias("sh_row")).select("sh_row", F.lit(True).alias("stays"))
    fate = members.groupBy("sh_row").agg(F.count("*").alias("n")).join(stay, "sh_row", "left")
    fate = stable(fate.filter("stays is null or n > 1"))
    left = filtered(rows, fate.select("sh_row"), "sh_row", "left_anti")
    # rows that occur more than once, of which one stays
    again = stable(fate.filter("stays").select("sh_row"))
    if not again.isEmpty():
        left = left.unionByName(filtered(rows, again, "sh_row", "left_semi").dropDuplicates(["sh_row"]))
    return left.drop("sh_row").toDF(*docs.columns)


def op4_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
