"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample on the driver; every vector is then indexed by
descending it. A query walks the tree through a priority queue ordered by its inner
product with the nodes' centres and visits leaves until two things hold: the number of
visits that reached the calibrated recall, and enough candidates. The visits are
calibrated by widening them until a sample of queries, searched exactly against all
vectors, finds the wanted share of its true neighbours.

Neighbouring leaves form parts of about ``block`` candidates. A query is sent once to each
part it visits, with the list of its leaves there, and comes back with one list of answers,
however many of the part's leaves it visits. Queries meet candidates in blocks of bounded
size on both sides, so neither a crowded leaf nor a popular one fills a task. Equal vectors
are searched once: of each, the k + 1 smallest ids can be answers, and equal queries share
one search.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import stable, table, tidy


@dataclass(frozen=True)
class Plan:
    """sample: vectors the tree is fitted on; sample_bytes bounds it for wide vectors; branching: children of
    a node; leaf: vectors a leaf should hold; calibration: queries searched exactly; recall: what they must
    reach; block, visits: candidates and queries that meet at once. Beyond sample / least leaves, leaves grow with
    the data instead of their number."""

    sample: int = 100_000
    sample_bytes: int = 64 << 20
    branching: int = 12
    leaf: int = 200
    least: int = 4
    rounds: int = 8
    calibration: int = 96
    recall: float = 0.97
    block: int = 4096
    visits: int = 4096
    seed: int = 42


@dataclass
class Tree:
    """centres[i]: of node i; children[i]: its children's numbers, none for a leaf; leaf[i]: a leaf's number."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = np.stack([self.centres[k] for k in kids])
            best = np.argmin((c * c).sum(1) - 2 * (x[rows] @ c.T), axis=1)
            todo += [(k, rows[best == i]) for i, k in enumerate(kids) if (best == i).any()]
        return out

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield self.leaf[node]
                continue
            for k, s in zip(kids, (self._stack(node) @ q).tolist(), strict=True):
                heapq.heappush(queue, (-s, k))

    def _stack(self, node: int) -> np.ndarray:
        cache = self.__dict__.setdefault("_stacked", {})
        if node not in cache:
            cache[node] = np.stack([self.centres[k] for k in self.children[node]])
        return cache[node]


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
    return centres, np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)


def fit_tree(sample: np.ndarray, total: int, plan: Plan) -> Tree:
    """A tree with about total / leaf leaves, from a sample of distinct vectors."""
    tree, rng = Tree(), np.random.default_rng(plan.seed)
    leaves = max(1, min(total // plan.leaf, len(sample) // plan.least))
    most = max(1, len(sample) // leaves)

    def grow(rows: np.ndarray) -> int:
        me = len(tree.centres)
        tree.centres.append(sample[rows].mean(axis=0) if len(rows) else np.zeros(sample.shape[1]))
        tree.children.append([])
        tree.leaf.append(-1)
        wanted = min(plan.branching, -(-len(rows) // most))
        if wanted > 1 and leaves > 1:
            _, near = _kmeans(sample[rows], wanted, plan.rounds, rng)
            groups = [rows[near == i] for i in range(wanted) if (near == i).any()]
            if len(groups) > 1:
                tree.children[me] = [grow(g) for g in groups]
                return me
        tree.leaf[me] = tree.leaves
        tree.leaves += 1
        return me

    grow(np.arange(len(sample)))
    return tree


# ---- vectors


def usable(rows: DataFrame) -> tuple[DataFrame, str, int]:
    """(vec_id, v): vectors of the commonest length that are neither null, zero nor partly null or non-finite;
    v is their bytes. Also the numpy type of v and the length."""
    real = F.filter("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.select("vec_id", "embedding").filter("vec_id is not null and embedding is not null").filter((F.size(real) == F.size("embedding")) & F.exists("embedding", lambda x: x != 0))
    lengths = good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").limit(1).collect()
    d = lengths[0].d if lengths else 0
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind) + 0.0  # no negative zeros
            raw = flat.reshape(-1, d)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([r.tobytes() for r in raw], pa.binary())], ["vec_id", "v"])

    return good.filter(F.size("embedding") == d).mapInArrow(tidy(run), "vec_id long, v binary"), kind, d


def _matrix(column, kind: str, d: int) -> np.ndarray:
    parts = column.to_pylist() if hasattr(column, "to_pylist") else column
    return np.frombuffer(b"".join(parts), kind).reshape(-1, d).astype(np.float64)


def _best(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, leaf: np.ndarray | None = None, visited: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(scores, ids, places) of each query's k best candidates; scores are summed in one fixed order.

    With visited, a query only meets candidates whose leaf is among its own; candidates are then sorted by leaf.
    """
    step = max(1, 2_000_000 // max(1, len(c)))
    if visited is not None:
        names, first = np.unique(leaf, return_index=True)
        upto = np.append(first[1:], len(leaf))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        if visited is None:
            rough = part @ c.T
        else:
            rough = np.full((len(part), len(c)), -np.inf)
            mine = visited[at : at + step]
            who = np.repeat(np.arange(len(part)), [len(v) for v in mine])
            where = np.concatenate(mine)
            order = np.argsort(where, kind="stable")
            who, where = who[order], where[order]
            for name, lo, hi, a, b in zip(names.tolist(), first.tolist(), upto.tolist(), np.searchsorted(where, names).tolist(), np.searchsorted(where, names, "right").tolist(), strict=True):
                if b > a:
                    rough[who[a:b], lo:hi] = part[who[a:b]] @ c[lo:hi].T
        floor = np.partition(rough, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(rough), -np.inf)
        slack = np.where(np.isfinite(floor), 1e-9 * (1 + np.abs(floor)), 0.0)
        for i, row in enumerate(rough):
            near = np.flatnonzero((row >= floor[i] - slack[i]) & (row > -np.inf))
            exact = (c[near] * part[i]).sum(axis=1)
            order = np.lexsort((ids[near], -exact))[:k]
            yield exact[order], ids[near][order], near[order]


def _answers(kind_rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*kind_rows, strict=True)], names)


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """(group, found): the k best of each group's answers."""
    spark = parts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "group long, found array<struct<score:double,vec_id:long,leaf:long>>"
    kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("leaf", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def close():
            s, v, f = (np.frombuffer(b"".join(h[i] for h in held), t) for i, t in enumerate(("<f8", "<i8", "<i8")))
            v, first = np.unique(v, return_index=True)  # a repeated row is one candidate
            s, f = s[first], f[first]
            order = np.lexsort((v, -s))[:k]
            out.append((now, [{"score": a, "vec_id": b, "leaf": c} for a, b, c in zip(s[order].tolist(), v[order].tolist(), f[order].tolist(), strict=True)]))

        for b in batches:
            for group, *row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if group != now and held:
                    close()
                    held = []
                now = group
                held.append(row)
                if len(held) >= 256:  # keep a group's answers few
                    close()
                    _, best = out.pop()
                    held = [(np.array([x["score"] for x in best], "<f8").tobytes(), np.array([x["vec_id"] for x in best], "<i8").tobytes(), np.array([x["leaf"] for x in best], "<i8").tobytes())]
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int64()), pa.array([x for _, x in out], kind)], ["group", "found"])
                    out = []
        if held:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int64()), pa.array([x for _, x in out], kind)], ["group", "found"])

    return parts.repartition(n, "group").sortWithinPartitions("group").mapInArrow(tidy(run), schema)


ANSWER = "group long, s binary, v binary, f binary"
ANSWER_NAMES = ["group", "s", "v", "f"]


def search(rows: DataFrame, every: int = 20, k: int = 20, plan: Plan = Plan()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each usable row whose vec_id is divisible by ``every``, its k best others.

    Vectors that are null, zero, partly null or non-finite, or not of the commonest length take no part, nor
    do rows without a vec_id. vec_id is a key: a row never answers a query of its own vec_id, and repeated
    rows are one candidate. Ties go to the smaller vec_id. Fewer others than k give fewer rows; an empty
    table none. Only vec_id and embedding are looked at.
    """
    spark = rows.sparkSession
    base, kind, d = usable(rows)
    base = stable(base)
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # A repeated row is one candidate. Equal vectors are equally near: the k + 1 smallest ids are all that a query can be given.
    first = Window.partitionBy("v").orderBy("vec_id")
    distinct = base.dropDuplicates(["vec_id", "v"]).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    total = base.count()
    wanted = max(1, min(plan.sample, plan.sample_bytes // (d * 8)))
    share = int(min(1.0, 0.9 * wanted / total) * (1 << 30))
    by_hash = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30))
    sample = [r.v for r in base.filter(by_hash(plan.seed) < share).orderBy("vec_id").limit(wanted).collect()]
    sample = _matrix(sorted(set(sample)), kind, d) if sample else np.zeros((0, d))
    tree = fit_tree(sample, total, plan)
    shared = spark.sparkContext.broadcast(tree)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.place(_matrix(b.column("v"), kind, d)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(leaf)], ["vec_id", "v", "leaf"])

    index = stable(distinct.select("vec_id", "v").mapInArrow(tidy(placed), "vec_id long, v binary, leaf long"))
    held = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        held[r.leaf] = r.n

    asked = base.filter(F.col("vec_id") % every == 0)
    members = asked.groupBy("v", "vec_id").agg(F.lit(1)).select("v", "vec_id")
    groups = stable(asked.groupBy("v").agg(F.min("vec_id").alias("group")))
    visits = calibrated(index, groups, tree, kind, d, k, plan)

    part = np.zeros(tree.leaves, np.int64)  # of each leaf: neighbours in the tree, up to about a block
    filled, now = 0, 0
    for leaf in range(tree.leaves):
        if filled and filled + held[leaf] > plan.block:
            filled, now = 0, now + 1
        part[leaf], filled = now, filled + held[leaf]

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "v", "part", "at"]
        for b in batches:
            q = _matrix(b.column("v"), kind, d) if b.num_rows else np.zeros((0, d))
            out = []
            for i, (group, raw) in enumerate(zip(b.column("group").to_pylist(), b.column("v").to_pylist(), strict=True)):
                seen, met = [], 0
                for leaf in shared.value.walk(q[i]):
                    seen.append(leaf)
                    met += held[leaf]
                    if len(seen) >= visits and met > k:
                        break
                leaves = np.sort(np.array(seen, np.int32))
                cuts = np.flatnonzero(np.diff(part[leaves])) + 1
                out += [(group, raw, int(part[x[0]]), x.tobytes()) for x in np.split(leaves, cuts)]
                if len(out) >= 10_000:
                    yield _answers(out, names)
                    out = []
            if out:
                yield _answers(out, names)

    visited = stable(groups.select("group", "v").mapInArrow(tidy(walked), "id long, v binary, part long, at binary"))
    calls = {r.part: r.n for r in visited.groupBy("part").agg(F.count("*").alias("n")).collect()}
    inside = np.bincount(part, held)
    shape = {p: (p, max(1, -(-int(inside[p]) // plan.block)), max(1, -(-n // plan.visits))) for p, n in calls.items() if inside[p]}
    # One row a part, and one a leaf: at most sample / least of them.
    shapes = F.broadcast(spark.createDataFrame(list(shape.values()) or [(-1, 1, 1)], "part long, blocks long, turns long"))
    leaves = F.broadcast(spark.createDataFrame([(leaf, *shape[p]) for leaf, p in enumerate(part.tolist()) if p in shape] or [(-1, -1, 1, 1)], "leaf long, part long, blocks long, turns long"))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cell = F.xxhash64("part", "block", "turn").alias("cell")
    own = F.unhex(F.lpad(F.hex("leaf"), 8, "0"))  # big-endian, 4 bytes
    here = index.join(leaves, "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks")).select("*", span("turns").alias("turn")).select(cell, F.lit(0).alias("side"), F.col("vec_id").alias("id"), "v", own.alias("at"))
    ask = visited.join(shapes, "part").withColumn("turn", F.pmod(F.xxhash64("id"), "turns")).select("*", span("blocks").alias("block")).select(cell, F.lit(1).alias("side"), "id", "v", "at")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, c_ids, c_raw, c_at, q_ids, q_raw, q_at = None, [], [], [], [], [], []

        def close():
            if not q_ids or not c_ids:
                return
            leaf = np.frombuffer(b"".join(c_at), ">i4").astype(np.int64)
            order = np.argsort(leaf, kind="stable")
            ids, leaf = np.array(c_ids, np.int64)[order], leaf[order]
            own = [np.frombuffer(x, np.int32) for x in q_at]
            found = _best(_matrix(q_raw, kind, d), _matrix(c_raw, kind, d)[order], ids, k + 1, leaf, own)
            rows = [(g, s.tobytes(), v.tobytes(), leaf[at].tobytes()) for g, (s, v, at) in zip(q_ids, found, strict=True)]
            yield _answers(rows, ANSWER_NAMES)

        for b in batches:
            for cell, side, i, raw, at in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
                if cell != now:
                    yield from close()
                    now, c_ids, c_raw, c_at, q_ids, q_raw, q_at = cell, [], [], [], [], [], []
                (q_ids if side else c_ids).append(i)
                (q_raw if side else c_raw).append(raw)
                (q_at if side else c_at).append(at)
        yield from close()

    parts = here.unionByName(ask).repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(tidy(met), ANSWER)
    best = _merged(parts, k + 1)
    named = members.join(groups, "v").select("group", F.col("vec_id").alias("query_id"))
    found = named.join(best, "group")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return found.select("query_id", F.posexplode(others).alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def calibrated(index: DataFrame, groups: DataFrame, tree: Tree, kind: str, d: int, k: int, plan: Plan) -> int:
    """Leaf visits at which a sample of queries, searched exactly against all vectors, reaches the wanted recall."""
    some = groups.orderBy(F.xxhash64(F.lit(plan.seed), "group")).limit(plan.calibration).collect()
    if tree.leaves == 1 or not some:
        return 1
    ids, q = [r.group for r in some], _matrix([r.v for r in some], kind, d)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = b.column("leaf").to_numpy()
                found = _best(q, _matrix(b.column("v"), kind, d), b.column("vec_id").to_numpy(), k + 1)
                yield _answers([(g, s.tobytes(), v.tobytes(), leaf[at].tobytes()) for g, (s, v, at) in zip(ids, found, strict=True)], ANSWER_NAMES)

    true = {r.group: [x.leaf for x in r.found if x.vec_id != r.group][:k] for r in _merged(index.mapInArrow(tidy(exact), ANSWER), k + 1).collect()}
    hits, wanted = np.zeros(tree.leaves), 0
    for g, v in zip(ids, q, strict=True):
        order = {leaf: i for i, leaf in enumerate(tree.walk(v))}
        for leaf in true.get(g, []):
            hits[order[leaf]] += 1
            wanted += 1
    reached = np.cumsum(hits) >= plan.recall * wanted
    return int(np.argmax(reached)) + 1


def op3_ann(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))
