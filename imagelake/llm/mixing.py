"""Mixing overlapping sources to target weights by min-cost flow.

Documents that belong to the same set of sources form a pattern. Per pattern only its number of words counts,
so the flow network is small: start -> pattern -> each of its sources -> end. A pattern offers its words once
for nothing, a second time at cost 1, a third at cost 3, and so on (convex), up to `max_repeats` times; a
source takes up to its target. The flow of least cost says how many words each pattern gives: whole passes
over all its documents, and a part of one pass. The documents of that part are the first in a seeded order
whose words fill it. Where it ends is found by histograms over the order's leading bits, LEVEL_BITS at a time, each
within the bucket that the one before it names; so of a pattern only the rows of one last bucket are sorted.

Targets: the sources, ordered by code point with null last, weigh 1, 2, ..., `weights`, 1, 2, ... and share
all words; a target stops at `max_repeats` times its source's words, and the rest is shared again by weight.

Defined results: a null text has 0 words and takes 0; a null source (or an empty list of sources) is a source
of its own; equal rows may differ in the last pass, though always in the same way; an empty table gives an
empty result; other columns are passed by.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imagelake.llm.common import table

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the seeded order, those that one histogram tells apart, and how many histograms there are.
ORDER_BITS, LEVEL_BITS, LEVELS = 60, 7, 3


def targets(sizes: dict[str | None, int], weights: int = 3, max_repeats: int = 3) -> dict[str | None, float]:
    """Water filling; sizes are words by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % weights + 1 for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), names, {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > max_repeats * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: float(max_repeats * sizes[s]) for s in full}
        left -= sum(max_repeats * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(patterns: dict[tuple, int], quota: dict, max_repeats: int) -> dict[tuple, int]:
    """Words that each pattern gives. Successive shortest paths with potentials; arcs start -> pattern come once
    for each pass with costs 0, 1, 3, 6, ..., so paths are never cheaper later."""
    start, end = "start", "end"
    arcs: list[list] = []  # to, capacity, cost; arc i ^ 1 is the reverse of i
    out: dict = defaultdict(list)

    def arc(a, b, capacity: int, cost: int) -> None:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, c, w])

    for p, size in patterns.items():
        for k in range(max_repeats):
            arc(start, ("p", p), size, k * (k + 1) // 2)
        for s in p:
            arc(("p", p), ("s", s), max_repeats * size, 0)
    for s, q in quota.items():
        arc(("s", s), end, q, 0)
    potential = defaultdict(int)
    while True:
        best, via, heap, order = {start: 0}, {}, [(0, 0, start)], 1
        while heap:
            d, _, x = heapq.heappop(heap)
            if d > best[x]:
                continue
            for i in out[x]:
                y, capacity, cost = arcs[i]
                if capacity > 0 and (to := d + cost + potential[x] - potential[y]) < best.get(y, 1 << 62):
                    best[y], via[y] = to, i
                    heapq.heappush(heap, (to, order, y))
                    order += 1
        if end not in best:
            break
        for x, d in best.items():
            potential[x] += min(d, best[end])
        for x in out:
            if x not in best:
                potential[x] += best[end]
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = arcs[via[x] ^ 1][0]
        amount = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= amount
            arcs[i ^ 1][1] += amount
    given = dict.fromkeys(patterns, 0)
    for i in out[start]:
        if i % 2 == 0:
            given[arcs[i][0][1]] += arcs[i ^ 1][1]
    return given


def leading(level: int) -> Column:
    return F.shiftright("order", ORDER_BITS - LEVEL_BITS * level)


def narrowed(sized: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """The plan with `cut` one level finer: the bucket of leading bits in which a pattern's part ends, and the words of the
    buckets before it. At most 2^LEVEL_BITS sums of a pattern meet in a window, at any input size."""
    inside = sized.withColumn("bucket", leading(level)).join(plan.select("pattern", F.col("cut").alias("above"), "before", "rest"), "pattern")
    inside = inside.filter(F.shiftright("bucket", LEVEL_BITS) == F.col("above"))
    sums = inside.groupBy("pattern", "bucket", "before", "rest").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("pattern").orderBy("bucket")
    sums = sums.withColumn("ahead", F.col("before") + F.sum("words").over(running) - F.col("words"))
    # The last bucket that begins before the part's end; where no words are left for a part, the first one.
    found = sums.groupBy("pattern").agg(
        F.coalesce(F.max(F.when(F.col("ahead") <= F.col("rest"), F.col("bucket"))), F.min("bucket")).alias("cut"),
        F.coalesce(F.max(F.when(F.col("ahead") <= F.col("rest"), F.col("ahead"))), F.min("ahead")).alias("before"),
    )
    return plan.drop("cut", "before").join(found, "pattern")


def mix(docs: DataFrame, sources: Column | None = None, weights: int = 3, max_repeats: int = 3, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs with doc_id and text -> one row per row: doc_id, sources, size, source_size,
    target, copies, taken, text_key, the hash of the text that tells rows with one doc_id apart, and the columns in
    `carry`, which go along with their row and are never shuffled.

    sources: an array column with each document's sources; default: array(source). source_size and target are
    those of the document's first source. copies: how often the mix takes the document, 0 to max_repeats.
    The driver receives one row per distinct set of sources, whatever the number of documents.
    """
    spark = docs.sparkSession
    if sources is None:
        sources = F.array("source")
    sources = F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, F.array_sort(F.array_distinct(sources))).otherwise(
        F.array(F.lit(None).cast("string"))
    )
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name))
    order = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        sources.alias("sources"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("order"),
        F.xxhash64("text").alias("text_key"),
        *carry,
    )
    sized = table(sized.withColumn("pattern", F.to_json("sources", {"ignoreNullFields": "false"})), "sized")
    patterns, key = {}, {}
    found = sized.groupBy("pattern", "sources").agg(F.sum("size").alias("size")).collect()
    for r in sorted(found, key=lambda r: r["pattern"]):  # of several flows of least cost always the same one
        patterns[tuple(r["sources"])], key[tuple(r["sources"])] = r["size"], r["pattern"]
    sizes: dict = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    goal = targets(sizes, weights, max_repeats)
    if any(len(p) > 1 for p in patterns):  # a word of several sources is one word to share
        scale = sum(patterns.values()) / max(1, sum(sizes.values()))
        goal = {s: t * scale for s, t in goal.items()}
    given = min_cost_flow(patterns, {s: math.floor(t + 0.5) for s, t in goal.items()}, max_repeats)
    # A written table has a true size, from which Spark chooses: a broadcast of a small plan, else a join that it splits
    # where a pattern has very many rows.
    plan = spark.createDataFrame(
        [(key[p], sizes[p[0]], float(goal[p[0]]), *(divmod(given[p], n) if n else (0, 0)), 0, 0) for p, n in patterns.items()],
        "pattern string, source_size long, target double, passes long, rest long, cut long, before long",
    )
    plan = table(plan, "plan")
    for level in range(1, LEVELS + 1):
        plan = table(narrowed(sized.select("pattern", "order", "size"), plan, level), "plan")
    rows = sized.join(plan, "pattern").withColumn("bucket", leading(LEVELS))
    # Only rows of the buckets where a part ends are sorted.
    ties = F.xxhash64(*carry) if carry else F.lit(0)
    within = Window.partitionBy("pattern").orderBy("order", "doc_id", "text_key", ties).rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter("bucket = cut").withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    last = last.withColumn("extra", (F.col("size") > 0) & (F.col("rest") > 0) & (2 * F.col("ahead") + F.col("size") <= 2 * F.col("rest")))
    other = rows.filter("bucket != cut").withColumn("extra", (F.col("size") > 0) & (F.col("rest") > 0) & (F.col("bucket") < F.col("cut")))
    columns = ["doc_id", "text_key", "sources", "size", "source_size", "target", "passes", "extra", *carry]
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("extra").cast("long")).otherwise(0)
    return (
        other.select(columns).unionByName(last.select(columns))
        .select("doc_id", "text_key", "sources", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carry)
    )
