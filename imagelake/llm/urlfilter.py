"""URL filters by a temporal list join, in DataFrame operations only.

List entries are dated: an `add` makes a pattern active in its category from its date on, until a `remove` or the
next entry of that pattern and category. Sorted by date they become validity intervals. A capture is held against the entries active at its
fetch date by an as-of join: its URL names the few patterns that could match (each domain above its host, the
host, each leading part of its path, as far as the list's longest entries go), and these meet the intervals on equality of the pattern with the date
within. Intervals of one pattern and category don't overlap, so a capture meets at most one per pattern and
category; the longest pattern decides, and of equally long ones a block. Captures are salted and intervals repeated per salt, so a
host with a third of all captures is spread.

Entries of one pattern, category and date: a remove beats an add; other categories are not touched by it, and a
null category is one of its own. An IPv6 address is a host with its brackets and without domains above it; steps
of a path are what stands between its slashes, empty ones left out. Defined results: a null or unparseable url has host null
and verdict none; so has a null date; null patterns, dates or actions in the list are no entries; repeated rows
of captures each get a row; an empty table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imagelake.llm.common import table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)"


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", F.regexp_replace(host, r"\.+$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (pattern, category, entry_date, action) -> (pattern, category, since, until); until is null while
    the last entry holds. Patterns: `d:` domain and all below it, `h:` exact host, `p:` host and leading path."""
    clean = entries.filter("pattern is not null and entry_date is not null and action in ('add', 'remove')")
    # One entry per pattern, category and date: of the same date a remove wins.
    daily = clean.groupBy("pattern", "category", "entry_date").agg(F.max("action").alias("action"))
    line = Window.partitionBy("pattern", "category").orderBy("entry_date")
    return (
        daily.withColumn("until", F.lead("entry_date").over(line))
        .filter("action = 'add'")
        .select("pattern", "category", F.col("entry_date").alias("since"), "until")
    )


def reach(active: DataFrame) -> tuple[int, int, int]:
    """Of the list: labels of its longest domain, steps of its deepest path, characters of its longest pattern."""
    name = F.substring("pattern", 3, 2**31 - 1)
    kind = lambda k, sep: F.max(F.when(F.col("pattern").startswith(k), F.size(F.split(name, sep))).otherwise(0))
    labels, steps, size = active.agg(kind("d:", r"\."), kind("p:", "/"), F.max(F.length("pattern"))).head()
    return labels or 0, (steps or 1) - 1, size or 0


def patterns_of(url: Column, host: Column, bounds: tuple[int, int, int]) -> Column:
    """What may match: the domains above a host and itself, the host, and leading paths, no longer than any pattern."""
    most_labels, most_steps, longest = bounds
    labels = F.when(host.startswith("["), F.array(host)).otherwise(F.split(host, r"\."))
    counted = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    domains = F.transform(counted(F.least(F.size(labels), F.lit(most_labels))), lambda n: F.concat(F.lit("d:"), F.array_join(F.slice(labels, -n, n), ".")))
    path = F.regexp_replace(F.regexp_extract(url, PATH, 1), "/+", "/")
    path = F.substring(path, 1, longest + 1)  # a step cut here is too long for any pattern
    steps = F.slice(F.filter(F.split(path, "/", most_steps + 2), lambda s: s != ""), 1, max(1, most_steps))
    paths = F.transform(
        counted(F.least(F.size(steps), F.lit(most_steps))),
        lambda n: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), n), "/")),
    )
    found = F.concat(domains, F.array(F.concat(F.lit("h:"), host)), paths)
    return F.when(host.isNotNull(), F.filter(found, lambda p: F.length(p) <= longest))


def url_filter(captures: DataFrame, entries: DataFrame, salts: int = 16, carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """captures (carry..., url, fetch_date) -> carry..., host, fetch_date, verdict (block, allow or none),
    pattern and category of the deciding entry, n_active entries that matched."""
    active = table(intervals(entries), "intervals")
    named = captures.select(*carry, "url", "fetch_date").withColumn("_row", F.monotonically_increasing_id())
    named = named.withColumn("host", host_of(F.col("url")))
    keyed = named.select(
        "_row", *carry, "host", "fetch_date", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int").alias("salt"),
        F.explode_outer(patterns_of(F.col("url"), F.col("host"), reach(active))).alias("key"),
    )
    active = active.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = keyed.join(
        active,
        (keyed.key == active.pattern) & (keyed.salt == active.salt) & (active.since <= keyed.fetch_date)
        & (active.until.isNull() | (keyed.fetch_date < active.until)),
        "left",
    )
    # The longest pattern (without its kind) first; of equal ones a block, then by name.
    block = (F.col("category") != "allow").cast("int")
    rank = F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("size"), block.alias("block"), F.col("pattern").alias("name"), F.col("category").alias("category")))
    best = met.groupBy("_row", *carry, "host", keyed.fetch_date).agg(F.max(rank).alias("best"), F.count("pattern").alias("n_active"))
    verdict = F.when(F.col("best").isNull(), "none").when(F.col("best.block") == 1, "block").otherwise("allow")
    return best.select(*carry, "host", "fetch_date", verdict.alias("verdict"), F.col("best.name").alias("pattern"), F.col("best.category").alias("category"), "n_active")
