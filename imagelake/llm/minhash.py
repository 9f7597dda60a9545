"""Near duplicates by DartMinHash signatures, bands and exact verification.

1. Every document becomes its weighted set of hashed word shingles; a shingle weighs as often as it occurs. Darts
   are thrown at the plane (weight, rank) of each element: a Poisson process that depends on the element alone,
   generated region by region. Those that land below the element's weight hit; each hit has a coordinate of the
   signature, and the earliest (lowest rank) hit of a coordinate is kept. Only ranks up to about k ln k over the
   total weight are looked at, doubling while a coordinate is empty, so a long document costs little more than
   its shingles. Two signatures agree in a coordinate with probability equal to the weighted Jaccard similarity,
   the sum of the smaller weights over the sum of the larger ones.
2. Documents with the same weighted set are one node. Nodes that share a band of `rows` coordinates meet in a
   bucket. A bucket isn't expanded into pairs: its members are compared with a pivot, exactly, and those it leaves
   outside with a few members of the bucket's largest class, a bounded number of rows a node. Weighted Jaccard
   distance is a metric, so a member that missed the pivot by more than twice the link distance can link to no
   member that hit it. What may still link across classes is compared within tasks: outsiders of a class in blocks
   against members of its buckets in blocks, both of bounded bytes, and only links are written. Nothing of this
   goes through the driver, and every size takes the same way.
3. Classes are the connected components of the verified links.

Defined results: texts without a word are classes of their own; a text shorter than a shingle is one shingle;
A-Z is lower-cased; null doc_ids are kept as rows, and a class's id is its smallest non-null doc_id; equal
rows share a class; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.llm.common import build_filter, drop_table, filter_slot, in_filter, mix, row_bytes, shingles, spread_join, table, word_hashes

# ---------------------------------------------------------------- signatures

_U = np.uint64
#: The first region of ranks; later ones double up to _STEP, then stay that wide.
_BASE, _STEP = 0.125, 64.0
#: Darts expected in a cell of the plane at most; larger cells are cut.
_DARTS = 64.0
_cdf: dict[float, np.ndarray] = {}


def _poisson(area: float) -> np.ndarray:
    """Distribution function of the number of darts in a region."""
    if area not in _cdf:
        p, total, out = math.exp(-area), 0.0, []
        k = 0
        while total < 1 - 1e-15 and k < 20 * area + 60:
            total += p
            out.append(total)
            k += 1
            p *= area / k
        _cdf[area] = np.array(out)
    return _cdf[area]


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def _cells(top: float, ranks: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """The plane below weight `top` within the regions of ranks: levels of weight [0, 1), [1, 2), [2, 4), ..., each
    region cut so that a cell expects _DARTS darts at most. Where cells lie doesn't depend on the document."""
    out, w0, w1 = [], 0.0, 1.0
    while w0 < top:
        for r0, r1 in ranks:
            n = max(1, math.ceil((r1 - r0) * (w1 - w0) / _DARTS))
            step = (r1 - r0) / n
            out += [(w0, w1, r0 + i * step, r0 + (i + 1) * step) for i in range(n)]
        w0, w1 = w1, 2 * w1
    return out


def _throw(elements: np.ndarray, weights: np.ndarray | None, ranks: list[tuple[float, float]], seed: int):
    """Darts that land below their element's weight, with ranks in the given regions: (hash, rank)."""
    cells = np.array(_cells(1.0 if weights is None else float(weights.max()), ranks))
    corner = np.ascontiguousarray(cells[:, [0, 2]]).view(_U)
    names = mix(corner[:, 0] ^ mix(corner[:, 1] + _U(seed)))
    if weights is None:
        owner = None
        key, sizes = mix((elements[None, :] + names[:, None]).ravel()), np.full(len(cells), len(elements))
    else:  # only elements that reach into a cell's level
        reach = {w: np.flatnonzero(weights > w) for w in set(cells[:, 0])}
        owner = np.concatenate([reach[w] for w in cells[:, 0]])
        sizes = np.array([len(reach[w]) for w in cells[:, 0]])
        key = mix(elements[owner] + np.repeat(names, sizes))
    u, count, at = _unit(key), np.empty(len(key), np.int64), 0
    for (w, x, r, s), n in zip(cells, sizes, strict=True):
        count[at : at + n] = np.searchsorted(_poisson(float((x - w) * (s - r))), u[at : at + n], side="right")
        at += n
    which = np.repeat(np.arange(len(key)), count)
    nth = np.arange(1, len(which) + 1) - (np.cumsum(count) - count)[which]
    dart = mix(key[which] ^ (nth.astype(_U) * _U(0x9E3779B97F4A7C15)))
    cell = np.repeat(np.arange(len(cells)), sizes)[which]
    low, high = cells[:, 2], cells[:, 3]
    rank = low[cell] + (high - low)[cell] * _unit(mix(dart + _U(1)))
    if weights is None:
        return dart, rank
    low, high = cells[:, 0], cells[:, 1]
    hit = low[cell] + (high - low)[cell] * _unit(mix(dart + _U(2))) < weights[owner[which]]
    return dart[hit], rank[hit]


def dart_minhash(elements: np.ndarray, k: int, weights: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """k hashes of 32 bits for distinct elements; weights: positive, default 1 each."""
    if weights is not None and (weights == 1).all():
        weights = None  # the same darts, without looking at weights
    total = float(len(elements) if weights is None else weights.sum())
    enough = (k * math.log(k) + 2 * k) / total
    regions = [(0.0, _BASE)]
    while regions[-1][1] < enough:
        regions.append((regions[-1][1], regions[-1][1] + min(regions[-1][1], _STEP)))
    signature, ranks = np.zeros(k, _U), np.full(k, np.inf)
    while True:
        dart, rank = _throw(elements, weights, regions, seed)
        order = np.argsort(rank)[::-1]  # the earliest is written last
        dart, rank = dart[order], rank[order]
        at = (mix(dart + _U(3)) % _U(k)).astype(np.int64)
        best, who = np.full(k, np.inf), np.zeros(k, _U)
        best[at], who[at] = rank, dart
        better = best < ranks
        signature[better], ranks[better] = who[better], best[better]
        if np.isfinite(ranks).all():
            return (mix(signature) >> _U(32)).astype(np.uint32)
        last = regions[-1][1]
        regions = [(last, last + min(last, _STEP))]


# ---------------------------------------------------------------- documents

_NODE_DDL = "row long, doc_id long, text_key long, node_key binary, n int, signature binary"


def weighted_shingles(text: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order and how often each occurs."""
    elements, counts = np.unique(shingles(word_hashes(text.lower()), words), return_counts=True)
    return elements, counts.astype(np.uint32)


def node_key(elements: np.ndarray, counts: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes() + counts.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int, k: int) -> DataFrame:
    """One row per document. `row` numbers the rows; the table it is written to fixes the numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        last: dict[bytes, bytes] = {}
        for b in batches:
            keys, sizes, made = [], [], []
            for text in row_bytes(b.column(1)):
                elements, counts = weighted_shingles(text or b"", words)
                key = node_key(elements, counts)
                keys.append(key)
                sizes.append(len(elements))
                if len(elements) and key not in last:
                    if len(last) >= 4096:
                        last.clear()
                    last[key] = dart_minhash(elements, k, counts).tobytes()
                made.append(last[key] if len(elements) else b"")
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(made, pa.binary())],
                ["row", "doc_id", "text_key", "node_key", "n", "signature"],
            )
            row += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text")).mapInArrow(run, _NODE_DDL)


def shingle_sets(docs: DataFrame, bitmap: bytes, words: int) -> DataFrame:
    """(doc_id, node_key, elements, counts) of the documents whose id passes the filter; counts are left out where
    all are 1."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            passed = pa.array(in_filter(bits, b.column(2).to_numpy()))
            keys, elements, counts = [], [], []
            for t in row_bytes(b.column(1).filter(passed)):
                e, c = weighted_shingles(t or b"", words)
                keys.append(node_key(e, c))
                elements.append(e.tobytes())
                counts.append(b"" if (c == 1).all() else c.tobytes())
            made = [pa.array(x, pa.binary()) for x in (keys, elements, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(passed), *made], ["doc_id", "node_key", "elements", "counts"])

    id_ = F.col("doc_id").cast("long")
    return docs.select(id_.alias("doc_id"), "text", filter_slot(id_).alias("slot")).mapInArrow(run, "doc_id long, node_key binary, elements binary, counts binary")


def unpacked(elements: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    e = np.frombuffer(elements, _U)
    return e, np.frombuffer(counts, np.uint32).astype(np.int64) if counts else np.ones(len(e), np.int64)


def weighted_jaccard(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Elements in order with their weights, on both sides."""
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    same = x[at] == y
    shared = int(np.minimum(wx[at[same]], wy[same]).sum())
    return shared / (int(wx.sum()) + int(wy.sum()) - shared)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their exact similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [weighted_jaccard(*unpacked(x, wx), *unpacked(y, wy)) for x, wx, y, wy in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    one = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"), F.col("counts").alias("wx"))
    two = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"), F.col("counts").alias("wy"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "wx", "y", "wy").mapInArrow(run, "a long, b long, similarity double")


# ---------------------------------------------------------------- comparisons within tasks


#: Cells of a group, and the smallest block worth a cell.
CELLS, _LEAST_BLOCK = 256, 32 << 10


class Members:
    """A block of members with two indexes: their places by bucket, and their weights by element."""

    def __init__(self, rows: list[tuple]):
        self.node, self.root = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        places = [(p["bucket"], i, p["away"], p["miss"]) for i, r in enumerate(rows) for p in r[2]]
        bucket, who, away, miss = (np.array(c) for c in zip(*places, strict=True))
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.who, self.away, self.miss = bucket[order], who[order], away[order], miss[order]
        sets = [unpacked(r[3], r[4]) for r in rows]
        elements, weight = np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets])
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(e) for e, _ in sets])
        order = np.argsort(elements, kind="stable")
        self.elements, self.weight, self.owner = elements[order], weight[order].astype(np.int32), owner[order]
        self.total = np.array([int(w.sum()) for _, w in sets])

    def candidates(self, places: list[dict], far: float) -> np.ndarray:
        """Those that share a bucket and that its pivot doesn't tell apart."""
        found = []
        for p in places:
            at = slice(np.searchsorted(self.bucket, p["bucket"]), np.searchsorted(self.bucket, p["bucket"], side="right"))
            found.append(self.who[at][(p["miss"] | self.miss[at]) & (np.abs(p["away"] - self.away[at]) <= far + 1e-9)])
        return np.unique(np.concatenate(found))

    def similarity(self, elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """To each member."""
        low = np.searchsorted(self.elements, elements)
        n = np.searchsorted(self.elements, elements, side="right") - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(self.owner[at], np.minimum(self.weight[at], np.repeat(weights, n)), len(self.node))
        return shared / (self.total + weights.sum() - shared)


def linked(outsiders: list[tuple], rows: list[tuple], threshold: float) -> list[tuple[int, int]]:
    """Links between outsiders and members of other classes; of classes that links have joined one link is enough."""
    m, out, far = Members(rows), [], 1 - threshold
    current, joined = m.root.copy(), {}
    for node, root, places, elements, counts in outsiders:
        while root in joined:
            root = joined[root]
        near = m.candidates(places, far)
        near = near[current[near] != root]
        elements, weights = unpacked(elements, counts)
        size = int(weights.sum())
        near = near[np.minimum(m.total[near], size) >= threshold * np.maximum(m.total[near], size) - 1e-9]
        if not len(near):
            continue
        near = near[m.similarity(elements, weights)[near] >= threshold - 1e-12]
        for other, v in zip(*np.unique(current[near], return_index=True), strict=True):
            v = int(m.node[near[v]])
            out.append((min(node, v), max(node, v)))
            joined[int(other)] = root
            current[current == other] = root
    return out


def across(open_: DataFrame, sets: DataFrame, threshold: float, block_bytes: int) -> DataFrame:
    """Links (a, b) between members outside their bucket's largest class and all others of the bucket.

    Buckets with the same largest class go together, so a member comes once for each of these with its places. A
    group's outsiders and its members are dealt into blocks, and each pair of blocks meets in a cell: rows grow with the
    outsiders' share, pairs are no rows, and a cell's memory is bounded. A group has about CELLS cells, so that its work
    is shared; with more bytes than these hold in blocks of block_bytes, it has more."""
    rows = open_.groupBy("major", "node", "root").agg(F.collect_list(F.struct("bucket", "away", "miss")).alias("places"))
    held = F.octet_length("elements") + F.octet_length("counts") + 40 * F.size("places") + 64
    rows = table(rows.join(sets, "node").withColumns({"minor": F.col("root") != F.col("major"), "bytes": held.cast("long")}), "inside")
    bytes_ = F.least(F.lit(block_bytes), F.greatest(F.lit(_LEAST_BLOCK), F.sqrt(F.sum("m") * F.sum("o") / CELLS)))
    blocks = lambda size: F.ceil(F.sum(size) / bytes_).cast("int")
    sized = spread_join(
        rows, "major", "node", [F.sum("bytes").alias("m"), F.sum(F.when(F.col("minor"), F.col("bytes")).otherwise(0)).alias("o")],
        [F.greatest(F.lit(1), blocks("m")).alias("m"), F.greatest(F.lit(1), blocks("o")).alias("o")],
    )
    name = F.xxhash64("node")
    columns = ["major", "i", "j", "outsider", "node", "root", "places", "elements", "counts"]
    meant = sized.filter("minor").withColumns({"i": F.pmod(name, F.col("o")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("m") - 1)), "outsider": F.lit(True)})
    others = sized.withColumns({"j": F.pmod(name, F.col("m")).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("o") - 1)), "outsider": F.lit(False)})
    n = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = meant.select(columns).union(others.select(columns)).repartition(n, "major", "i", "j").sortWithinPartitions("major", "i", "j", "outsider", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, members, outsiders = None, [], []
        for b in batches:
            links = []
            for major, i, j, outsider, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (major, i, j) != cell:
                    if outsiders and members:
                        links += linked(outsiders, members, threshold)
                    cell, members, outsiders = (major, i, j), [], []
                (outsiders if outsider else members).append(row)
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in links], pa.int64()) for k in (0, 1)], ["a", "b"])
        links = linked(outsiders, members, threshold) if outsiders and members else []
        yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- components


def tree_roots(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for links (a, b) with a < b, at most one for each b: a's of a's, until nothing lies above."""
    up = table(links.select(F.col("b").alias("node"), F.col("a").alias("root")), "trees")
    for _ in range(max_rounds):
        above = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
        higher = table(up.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "trees")
        done = not higher.filter("moved").head(1)
        up = higher.select("node", "root")
        if done:
            return up
    raise RuntimeError("trees did not settle")


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for the nodes of links (a, b): root is the smallest node of the component. Alternates two
    steps until all components are stars: neighbours above a node, then those below it, move to the smallest one
    known. Minima are tables of their own, so Spark can split the joins of a node with very many neighbours."""
    edges = table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    for _ in range(max_rounds):
        # every node of u's neighbourhood above u moves to the smallest node of it
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = table(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v"), "edges")
        # u, and its neighbours below it, move to the smallest of these
        least = table(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        made = table(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for t in (edges, low, large, least):
            drop_table(t)
        edges = made
        # Stars: every node has one edge up at most, and no root has one.
        degree = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        bent = degree.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")
        if not bent.head(1):
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


# ---------------------------------------------------------------- the operator


def rooted(members: DataFrame, known: DataFrame) -> DataFrame:
    """members with the root of their node's component."""
    return members.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))


def with_major(rest: DataFrame, known: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several classes, with the root of the largest of these."""
    rest = rooted(rest, known)
    sizes = rest.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
    several = sizes.agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    return rest.join(table(several.select("bucket", "major"), "several"), "bucket")


def partners(open_: DataFrame, most: int, threshold: float, slots: int = 8) -> DataFrame:
    """Pairs (a, b) of each outsider with up to `most` members of the largest classes of its buckets, drawn by hashes."""
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(slots))
    inner = open_.filter("root = major").groupBy("bucket", slot("node").alias("slot"))
    inner = inner.agg(F.max_by(F.struct("node", "away", "miss"), F.xxhash64(F.lit(1), "node")).alias("v"))
    outer = open_.filter("root != major").withColumn("slot", slot("bucket", "node"))
    may = (F.col("miss") | F.col("v.miss")) & (F.abs(F.col("away") - F.col("v.away")) <= 1 - threshold + 1e-9)
    drawn = outer.join(inner, ["bucket", "slot"]).filter(may).groupBy("node", "major")
    drawn = drawn.agg(F.slice(F.sort_array(F.collect_set(F.struct(F.xxhash64(F.lit(2), "v.node").alias("h"), F.col("v.node").alias("v")))), 1, most).alias("drawn"))
    pair = drawn.select("node", F.explode("drawn.v").alias("v"))
    return pair.select(F.least("node", "v").alias("a"), F.greatest("node", "v").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = 28, rows: int = 4, draws: int = 8, block_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size (rows), lead (one row of each class: that with
    class_id), and text_key, a hash of the text.

    A pair at the threshold shares no band with probability (1 - threshold^rows)^bands: 4e-7 by default. draws: members
    that an outsider is held against; block_bytes: of either side of a cell. Both change the cost only.
    """
    k, far = bands * rows, 1 - threshold
    made = table(signatures(docs, words, k), "signatures")
    least = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    nodes = table(
        made.filter("n > 0").groupBy("node_key").agg(F.min("row").alias("node"), F.first("signature").alias("signature"), F.min(least).alias("least"), F.count(F.lit(1)).alias("copies")),
        "nodes",
    )
    # Its document's text stands for the node, so any doc_id of the node will do; a null one is found as well.
    bucket = F.xxhash64(F.col("band"), F.expr(f"substring(signature, 4 * {rows} * band + 1, 4 * {rows})"))
    member = nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")).select("node", bucket.alias("bucket"))
    # Only buckets with company: pivots for all of them, by a map-side minimum.
    pivots = table(member.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "pivots")
    active = table(member.join(pivots, "bucket"), "members")
    drop_table(pivots)
    wanted = table(
        active.select("node").distinct().join(nodes, "node").select("node", "node_key", F.col("least.doc_id").alias("doc_id")), "wanted"
    )
    bitmap = build_filter(wanted.select(filter_slot(F.col("doc_id"))))
    found, w = shingle_sets(docs, bitmap, words).alias("f"), wanted.alias("w")
    sets = table(
        found.join(w, F.col("f.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("f.node_key") == F.col("w.node_key")))
        .select("w.node", "f.elements", "f.counts").dropDuplicates(["node"]),
        "sets",
    )
    is_link = F.col("similarity") >= threshold - 1e-12
    # First one pivot for each node, the one it shares most bands with; then, where a bucket still holds several
    # classes, all of its pivot's pairs.
    shared = active.filter("node != pivot").groupBy("pivot", "node").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy(F.col("node").alias("b")).agg(F.max_by("pivot", F.struct("n", "pivot")).alias("a")).select("a", "b")
    first = table(verified(table(best, "pairs"), sets), "scored")
    known = table(tree_roots(first.filter(is_link)), "classes")
    mixed = table(rooted(active, known).groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("bucket"), "mixed")
    active = table(active.join(mixed, "bucket", "left_semi"), "members")
    others = active.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    scored = table(verified(table(others, "pairs"), sets).union(first), "scored")
    # What pivots leave: a member that missed its pivot may link to members that the pivot doesn't tell apart from it.
    rest = active.filter("members > 2 and node != pivot").select("bucket", "node", "pivot").alias("r")
    rest = rest.join(scored.alias("s"), (F.col("r.pivot") == F.col("s.a")) & (F.col("r.node") == F.col("s.b"))).select("bucket", "node", (1 - F.col("similarity")).alias("away"))
    rest = table(rest, "rest")
    miss = F.col("away") > far + 1e-12
    reach = rest.filter(miss).groupBy("bucket").agg(F.count(F.lit(1)).alias("misses"), F.min("away").alias("nearest"))
    reach = table(reach.filter((F.col("misses") > 1) | (F.col("nearest") <= 2 * far + 1e-9)), "reach")
    rest = rest.join(reach.select("bucket", "nearest"), "bucket").filter(miss | (F.col("away") >= F.col("nearest") - far - 1e-9))
    rest = table(rest.select("bucket", "node", "away", miss.alias("miss")), "rest")
    # Two members of different classes: one of them is outside its bucket's largest class. Most of those that link
    # into it do so to many of its members, and a few drawn ones show it.
    drawn = table(partners(with_major(rest, known), draws, threshold), "pairs")
    links = table(scored.union(verified(drawn, sets)).filter(is_link).select("a", "b"), "links")
    known = table(components(links), "classes")
    found = table(across(table(with_major(rest, known), "open"), sets, threshold, block_bytes), "links")
    if found.head(1):
        known = table(components(links.union(found)), "classes")
    # Classes of several nodes; a class may hold a third of all nodes, and a node a third of all rows, so what is
    # known of either is dealt out by salts. The row that leads a class is the first of those with its id.
    joined = table(known.join(nodes.select("node", "node_key", "least", "copies"), "node"), "joined")
    sums = [F.min("least").alias("least"), F.sum("copies").alias("copies")]
    named = spread_join(joined.select("node", "node_key", "root", "least", "copies"), "root", "node", sums, [F.min("least").alias("class_least"), F.sum("copies").alias("class_size")])
    named = nodes.select("node_key", "least", "copies").join(named.select("node_key", "class_least", "class_size"), "node_key", "left")
    named = table(named.select("node_key", F.coalesce("class_least", "least").alias("least"), F.coalesce("class_size", "copies").alias("size")), "named")
    out = made.select("row", "doc_id", "text_key", "node_key", "n").join(named, "node_key", "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("size")).alias("class_size"),
        (alone | (F.col("row") == F.col("least.row"))).alias("lead"),
        "text_key",
    )
