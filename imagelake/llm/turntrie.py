"""A prefix trie of conversations: one node for each distinct sequence of first turns.

Turns are (role, text). Their texts never move: each row keeps a SHA-256 of its turn, a dictionary gives every distinct
one an integer, and a conversation becomes an array of integers. Equal conversations are one entry with its members'
number, its smallest member and a digest of all members; a member list is streamed in sorted parts, never gathered.

Entries are then put in buckets by most significant digit first, the digits being turn ids. A round takes every bucket
that is too large for one task: smallest and largest entry show how far all its entries agree (one chain of nodes),
and the next digit deals the entries to buckets of their own, named by a digest of their path. A round is one
aggregation and one join, whatever the bucket's depth or size, so a first turn that a third of all conversations share
costs one round. Buckets that fit are finished within a task by multikey quicksort: entries are parted by one turn at a
time into smaller, equal and larger ones, and each equal part is a node. Figures of subtrees come up from the
finished buckets through the rounds in reverse.

A task holds one bucket of at most `rows` entries and `turns` turn ids (8 bytes each, and their words), or one entry.

Defined results: rows without a conv_id belong to no conversation; turns are ordered by turn (null first), then role,
then the digest of the turn, and repeated rows are repeated turns; null role and text read as empty; a very long text
counts as one id; a table without conversations has no node, not even the root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imagelake.llm.common import SPACE, table

EMPTY = hashlib.sha256(b"").hexdigest()
#: Parts of a bucket, or of a turn that very many conversations have, in joins.
SALTS = 128


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space."""
    plain = F.btrim(F.translate(text, SPACE, " " * len(SPACE)), F.lit(" "))
    return F.when(F.length(plain) == 0, 0).otherwise(F.size(F.split(plain, " +"))).cast("long")


def turn_digests(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest (of role and text) and words of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), word_count(text).alias("words")
    )
    rows = table(rows, "turns")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "digest", "words")


def encoded(rows: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """conv_id and turns, an array of (id, words) in order, from conv_id, pos, digest, words; conversations of `convs`
    without rows have an empty array. Ids come from a dictionary of the distinct digests."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    words = salted.groupBy("digest", "_salt").agg(F.first("words").alias("words")).groupBy("digest").agg(F.first("words").alias("words"), F.collect_set("_salt").alias("_salts"))
    ids = table(words.withColumn("id", F.monotonically_increasing_id()), "dictionary")
    spread = table(ids.select("digest", "id", F.explode("_salts").alias("_salt")), "spread")
    known = salted.join(spread, ["digest", "_salt"]).select("conv_id", F.struct("pos", "id", "words").alias("t"))
    if convs is not None:
        known = known.unionByName(convs.select("conv_id").withColumn("t", F.lit(None).cast(known.schema["t"].dataType)))
    return known.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


# ---------------------------------------------------------------- equal conversations

_TURNS = "array<struct<id:bigint,words:bigint>>"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one key (key, conv_id, turns), as parts: key, first, n, turns (of the first), list."""
    for b in batches:
        keys, ids, at, out = b.column(0).to_pylist(), b.column(1).to_pylist(), 0, []
        for i in range(1, b.num_rows + 1):
            if i == b.num_rows or keys[i] != keys[at]:
                out.append((at, i))
                at = i
        firsts = pa.array([i for i, _ in out], pa.int64())
        lists = [",".join(map(str, ids[i:j])) for i, j in out]
        columns = [b.column(0).take(firsts), b.column(1).take(firsts), pa.array([j - i for i, j in out], pa.int64()), b.column(2).take(firsts), pa.array(lists, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "first", "n", "turns", "list"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key from its sorted parts; a list is hashed part by part."""
    key = row = digest = None
    for b in batches:
        keys, firsts, counts, lists, done = b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(4).to_pylist(), []
        for i, k in enumerate(keys):
            if k != key:
                if key is not None:
                    done.append((*row, digest.hexdigest()))
                key, row, digest = k, [firsts[i].as_py(), 0, b.column(3).slice(i, 1)], hashlib.sha256(lists[i].encode())
            else:
                digest.update(b"," + lists[i].encode())
            row[1] += counts[i]
        if done:
            yield _entries(done)
    if key is not None:
        yield _entries([(*row, digest.hexdigest())])


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.concat_arrays([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.string())], ["conv_id", "n", "turns", "ends"])


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """conv_id (the smallest member), n (members), turns and ends (SHA-256 of the sorted members) of each distinct sequence."""
    key = F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: t["id"].cast("string")), ",").cast("binary"), 256))
    rows = table(convs.select(key.alias("key"), "conv_id", "turns"), "sequences")
    parts = rows.repartitionByRange(_tasks(rows), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = table(parts.mapInArrow(_members, f"key binary, first long, n long, turns {_TURNS}, list string"), "parts")
    whole = parts.repartition(_tasks(rows), "key").sortWithinPartitions("key", "first")
    return whole.mapInArrow(_digested, f"conv_id long, n long, turns {_TURNS}, ends string")


# ---------------------------------------------------------------- buckets

_NODE_DDL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE = pa.schema([(n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", pa.string())])


def finished(entries: list[tuple], depth: int, parent: int | None) -> Iterator[tuple]:
    """The nodes below and at `depth` of a bucket whose entries (conv_id, n, turn ids, words, ends) agree on their first
    `depth` turns, top first; parent: its parent's conv_id. Multikey quicksort: a part is split by the ids at one
    place; what equals the pivot agrees on one turn more and is a node."""
    nodes: list[list] = []  # conv_id, depth, parent's place, n_convs, n_children, n_leaves, saved, ends

    def node(own: list[int], d: int, above: int | None) -> int:
        n = sum(entries[i][1] for i in own)
        words = entries[own[0]][3][d - 1] if d else 0
        nodes.append([min(entries[i][0] for i in own), d, above, n, 0, 0, (n - 1) * words, EMPTY])
        if above is not None and above >= 0:
            nodes[above][4] += 1
        return len(nodes) - 1

    everyone = list(range(len(entries)))
    work = [(everyone, depth, node(everyone, depth, None))]
    while work:
        own, d, at = work.pop()
        if len(own) == 1:  # the rest of one entry is a chain
            i = own[0]
            for more in range(d + 1, len(entries[i][2]) + 1):
                at = node(own, more, at)
            nodes[at][7] = entries[i][4]
            continue
        pivot = own[len(own) // 2]
        digit = entries[pivot][2][d] if d < len(entries[pivot][2]) else -1
        less, equal, more = [], [], []
        for i in own:
            x = entries[i][2][d] if d < len(entries[i][2]) else -1
            (equal if x == digit else less if x < digit else more).append(i)
        work += [(part, d, at) for part in (less, more) if part]
        if digit < 0:
            nodes[at][7] = entries[equal[0]][4]  # entries are distinct: one ends here
        else:
            work.append((equal, d + 1, node(equal, d + 1, at)))
    for x in reversed(nodes):
        x[5] = x[5] or 1
        if x[2] is not None:
            nodes[x[2]][5] += x[5]
            nodes[x[2]][6] += x[6]
    for x in nodes:
        above = parent if x[2] is None else nodes[x[2]][0]
        yield (x[0], x[1], above, *x[3:])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted buckets (bucket, up, parent, depth, conv_id, n, ends, turns), with `up`, the bucket above, in the top ones."""
    open_, entries, out = None, [], []

    def close() -> None:
        if entries:
            for k, x in enumerate(finished(entries, open_[3], open_[2])):
                out.append((*x, None if k else open_[1]))

    def handed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate([*_NODE, pa.field("up", pa.binary())])], [*_NODE.names, "up"])
        out.clear()
        return made

    for b in batches:
        heads = list(zip(*(b.column(i).to_pylist() for i in range(7)), strict=True))
        turns = b.column(7)
        flat = turns.flatten()
        ids, words = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        at = (turns.offsets.to_numpy() - turns.offsets[0].as_py()).tolist()
        for k, (bucket, up, parent, depth, conv_id, n, ends) in enumerate(heads):
            if open_ is None or bucket != open_[0]:
                close()
                open_, entries = (bucket, up, parent, depth), []
                if len(out) >= 10_000:
                    yield handed()
            entries.append((conv_id, n, ids[at[k] : at[k + 1]].tolist(), words[at[k] : at[k + 1]].tolist(), ends))
    close()
    yield handed()


def _agreed(a: str, b: str) -> Column:
    """How many first elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False).cast("long")
    return F.when(first == 0, F.size(same).cast("long")).otherwise(first - 1)


def conversation_trie(convs: DataFrame, rows: int = 256, turns: int = 1 << 18) -> DataFrame:
    """The nodes of convs (conv_id, turns: array of (id, words); conv_id distinct): conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over its subtree, words of each node's last turn times
    its members but one), ends_sha256 (of the sorted members that end here). Buckets of more than `rows` entries or
    `turns` turns go through another round."""
    # A bucket's own nodes begin at `depth`; up and parent: the bucket above and its smallest member.
    active = distinct_sequences(convs).select(
        F.lit(b"").alias("bucket"), F.lit(None).cast("binary").alias("up"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n", "ends", "turns"
    )
    active = table(active, "entries")
    rounds, done = [], None
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")
    while True:
        figures = active.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("entries"), F.sum(F.size("turns") - F.col("depth")).alias("size"), F.min("up").alias("up"), F.min("parent").alias("parent"), F.min("depth").alias("depth"),
            F.min("conv_id").alias("lead"), F.sum("n").alias("members"), F.min("turns").alias("low"), F.max("turns").alias("high"),
        )
        large = figures.filter((F.col("entries") > 1) & ((F.col("entries") > rows) | (F.col("size") > turns)))
        large = table(large.withColumn("to", _agreed("low", "high")).drop("entries", "size", "high"), "large")
        if large.isEmpty():
            local = active
        else:
            # An entry that ends where its bucket's chain ends has no further digit; distinct entries: one at most.
            joined = active.withColumn("_salt", salt).join(large.select("bucket", "lead", "to").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["bucket", "_salt"], "left").drop("_salt")
            joined = table(joined, "dealt")
            local = joined.filter("to is null").drop("lead", "to")
            ended = joined.filter("to = size(turns)").groupBy("bucket").agg(F.max("ends").alias("ends"))
            rounds.append(table(large.join(ended, "bucket", "left"), "chains"))
            digit = F.get("turns", F.col("to").cast("int"))["id"]
            name = F.unhex(F.md5(F.concat("bucket", F.concat_ws(":", F.col("to").cast("string"), digit.cast("string")).cast("binary"))))
            onward = joined.filter("to < size(turns)").select(name.alias("next"), F.col("bucket").alias("up"), F.col("lead").alias("parent"), (F.col("to") + 1).alias("depth"), "conv_id", "n", "ends", "turns")
            active = onward.withColumnRenamed("next", "bucket")
        own = local.repartition(_tasks(convs), "bucket").sortWithinPartitions("bucket", "conv_id").mapInArrow(_finish, _NODE_DDL + ", up binary")
        done = own if done is None else done.unionByName(own)
        if large.isEmpty():
            break
    done = table(done, "nodes")
    if not rounds:
        return done.drop("up")
    # Upwards: what stands below each bucket, from the finished ones and from the round after it.
    below = done.filter("up is not null").groupBy("up").agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    below, nodes = table(below, "below"), done.drop("up")
    sums = (F.sum("c").alias("c"), F.sum("l").alias("l"), F.sum("s").alias("s"))
    above = None
    for chains in reversed(rounds):
        under = below if above is None else below.unionByName(above)
        words = F.slice("low", F.greatest(F.col("depth"), F.lit(1)).cast("int"), (F.col("to") - F.greatest(F.col("depth"), F.lit(1)) + 1).cast("int"))
        saved = F.transform(words, lambda t: t["words"] * (F.col("members") - 1))
        # The root has no last text.
        saved = F.when(F.col("depth") == 0, F.concat(F.array(F.lit(0).cast("long")), saved)).otherwise(saved)
        found = chains.join(under.groupBy(F.col("up").alias("bucket")).agg(*sums), "bucket", "left").withColumn("saved", saved)
        found = table(found.withColumn("total", F.aggregate("saved", F.col("s"), lambda a, x: a + x)), "found")
        above = found.filter("up is not null").groupBy("up").agg(F.count(F.lit(1)).alias("c"), F.sum("l").alias("l"), F.sum("total").alias("s"))
        chain = found.select("*", F.posexplode("saved").alias("k", "own"))
        last = F.col("k") == F.size("saved") - 1
        # The subtree of a chain's node: its total less what stands above it.
        over = F.aggregate(F.slice("saved", 1, F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x)
        nodes = nodes.unionByName(chain.select(
            F.col("lead").alias("conv_id"), (F.col("depth") + F.col("k")).alias("depth"), F.when(F.col("k") == 0, F.col("parent")).otherwise(F.col("lead")).alias("parent_conv_id"),
            F.col("members").alias("n_convs"), F.when(last, F.col("c")).otherwise(1).cast("long").alias("n_children"), F.col("l").alias("n_leaves"), (F.col("total") - over).alias("saved_tokens"),
            F.when(last, F.coalesce("ends", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
        ))
    return nodes


def rebuilt(turns: DataFrame, family: int = 20) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, pos, digest, words) and ids of conversations that take their first h turns, h the checksum of the id
    modulo 4, from the conversation whose id is theirs rounded down to `family`, and keep their own after these."""
    own = table(turn_digests(turns), "digests")
    ids = table(own.select("conv_id").distinct(), "ids")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    heads = own.filter((F.col("conv_id") % family == 0) & (F.col("pos") < 3)).withColumnRenamed("conv_id", "base")
    taken = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(heads, "base").filter(F.col("pos") < h).drop("base")
    return own.filter(F.col("pos") >= h).unionByName(taken), ids
