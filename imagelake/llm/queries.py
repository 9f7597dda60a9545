"""The operators as queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imagelake.llm import quality as rules
from imagelake.llm.exactdedup import exact_dedup
from imagelake.llm.htmltext import extract
from imagelake.llm.langid import language_id
from imagelake.llm.linededup import line_dedup
from imagelake.llm.minhash import near_duplicates
from imagelake.llm.mixing import mix
from imagelake.llm.quality import quality
from imagelake.llm.recordfiles import record_round_trip
from imagelake.llm.sentencepieces import encode
from imagelake.llm.turntrie import conversation_trie, encoded, rebuilt
from imagelake.llm.urlfilter import HOST, PATH, host_of, url_filter
from imagelake.llm.variants import spelling_variants, word_counts
from imagelake.llm.warc import archive_round_trip

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_round_trip(read(spark, sf_dir, "pages"), min_bytes=100)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), keep="last").drop("text_key")


_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op2_exact_dedup"] = f"""
WITH n AS (SELECT doc_id, {_AZ.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def dated_captures(pages: DataFrame) -> DataFrame:
    """pages have no fetch date: page_id gives them one in 2024."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetch_date"))


def _number(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list as large as the pages' hosts call for, from hashes of names and paths."""
    start = F.lit("2024-01-01").cast("date")
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    names = hosts.select("host", F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("domain"))
    domains = names.filter("domain <> ''").select(F.concat(F.lit("d:"), "domain").alias("pattern")).distinct().withColumn("h", _number(F.col("pattern")))
    exact = names.select(F.concat(F.lit("h:"), "host").alias("pattern")).withColumn("h", _number(F.col("pattern")))
    first = F.concat(host_of(F.col("url")), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]+)", 1))
    paths = pages.select(F.concat(F.lit("p:"), first).alias("pattern")).filter("pattern is not null").distinct().withColumn("h", _number(F.col("pattern")))

    def entry(rows: DataFrame, keep, category, day, action: str) -> DataFrame:
        return rows.filter(keep).select("pattern", F.lit(category).alias("category"), F.date_add(start, day.cast("int")).alias("entry_date"), F.lit(action).alias("action"))

    h = F.col("h")
    fixed = pages.sparkSession.createDataFrame(
        [("d:example.net", "spam", "2024-03-01", "add"), ("d:example.net", "spam", "2024-05-01", "remove"), ("d:example.net", "spam", "2024-10-01", "add")],
        "pattern string, category string, day string, action string",
    )
    return (
        fixed.select("pattern", "category", F.col("day").cast("date").alias("entry_date"), "action")
        .union(entry(domains, h % 3 == 0, "adult", h % 200, "add"))
        .union(entry(domains, h % 6 == 0, "adult", h % 200 + 40, "remove"))
        .union(entry(domains, h % 9 == 0, "spam", h % 200 + 20, "add"))
        .union(entry(domains, h % 18 == 0, "spam", h % 200 + 60, "remove"))
        .union(entry(exact, h % 12 == 0, "malware", h % 150, "add"))
        .union(entry(exact, h % 24 == 0, "malware", h % 150 + 50, "remove"))
        .union(entry(exact, h % 4 == 0, "allow", h % 150, "add"))
        .union(entry(exact, h % 8 == 0, "allow", h % 150 + 100, "remove"))
        .union(entry(paths, h % 5 == 0, "malware", h % 300, "add"))
    )


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter(dated_captures(pages), dated_list(pages))
    return out.withColumn("fetch_date", F.col("fetch_date").cast("string"))


_NUM = "('0x' || substr(md5(pattern), 1, 8))::BIGINT"

ORACLES["op3_url_filters"] = rf"""
WITH c AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetch_date,
                  rtrim(lower(regexp_extract(url, '{HOST}', 1)), '.') AS host0,
                  regexp_extract(url, '{PATH}', 1) AS path FROM pages),
u AS (SELECT *, CASE WHEN host0 <> '' THEN host0 END AS host FROM c),
doms AS (SELECT DISTINCT 'd:' || regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS pattern FROM u WHERE regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) <> ''),
hosts AS (SELECT DISTINCT 'h:' || host AS pattern FROM u WHERE host IS NOT NULL),
paths AS (SELECT DISTINCT 'p:' || host || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]+)', 1) AS pattern FROM u WHERE host IS NOT NULL),
d AS (SELECT pattern, {_NUM} AS h FROM doms), e AS (SELECT pattern, {_NUM} AS h FROM hosts), p AS (SELECT pattern, {_NUM} AS h FROM paths),
entries AS (
  SELECT * FROM (VALUES ('d:example.net', 'spam', DATE '2024-03-01', 'add'), ('d:example.net', 'spam', DATE '2024-05-01', 'remove'),
                        ('d:example.net', 'spam', DATE '2024-10-01', 'add')) AS t(pattern, category, entry_date, action)
  UNION ALL SELECT pattern, 'adult', DATE '2024-01-01' + CAST(h % 200 AS INTEGER), 'add' FROM d WHERE h % 3 = 0
  UNION ALL SELECT pattern, 'adult', DATE '2024-01-01' + CAST(h % 200 + 40 AS INTEGER), 'remove' FROM d WHERE h % 6 = 0
  UNION ALL SELECT pattern, 'spam', DATE '2024-01-01' + CAST(h % 200 + 20 AS INTEGER), 'add' FROM d WHERE h % 9 = 0
  UNION ALL SELECT pattern, 'spam', DATE '2024-01-01' + CAST(h % 200 + 60 AS INTEGER), 'remove' FROM d WHERE h % 18 = 0
  UNION ALL SELECT pattern, 'malware', DATE '2024-01-01' + CAST(h % 150 AS INTEGER), 'add' FROM e WHERE h % 12 = 0
  UNION ALL SELECT pattern, 'malware', DATE '2024-01-01' + CAST(h % 150 + 50 AS INTEGER), 'remove' FROM e WHERE h % 24 = 0
  UNION ALL SELECT pattern, 'allow', DATE '2024-01-01' + CAST(h % 150 AS INTEGER), 'add' FROM e WHERE h % 4 = 0
  UNION ALL SELECT pattern, 'allow', DATE '2024-01-01' + CAST(h % 150 + 100 AS INTEGER), 'remove' FROM e WHERE h % 8 = 0
  UNION ALL SELECT pattern, 'malware', DATE '2024-01-01' + CAST(h % 300 AS INTEGER), 'add' FROM p WHERE h % 5 = 0),
daily AS (SELECT pattern, category, entry_date, max(action) AS action FROM entries GROUP BY pattern, category, entry_date),
iv AS (SELECT *, lead(entry_date) OVER (PARTITION BY pattern, category ORDER BY entry_date) AS until FROM daily),
act AS (SELECT pattern, category, entry_date AS since, until FROM iv WHERE action = 'add'),
m AS (SELECT u.page_id, act.pattern, act.category, length(act.pattern) AS size, CAST(act.category <> 'allow' AS INTEGER) AS block
      FROM u JOIN act ON act.since <= u.fetch_date AND (act.until IS NULL OR u.fetch_date < act.until) AND (
        (act.pattern LIKE 'd:%' AND ('.' || u.host) LIKE ('%.' || substr(act.pattern, 3))) OR act.pattern = 'h:' || u.host OR
        (act.pattern LIKE 'p:%' AND starts_with(u.host || u.path || '/', substr(act.pattern, 3) || '/')))),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY size DESC, block DESC, pattern DESC, category DESC) AS k, count(*) OVER (PARTITION BY page_id) AS n FROM m)
SELECT u.page_id, u.host, CAST(u.fetch_date AS VARCHAR) AS fetch_date, CASE WHEN r.pattern IS NULL THEN 'none' WHEN r.block = 1 THEN 'block' ELSE 'allow' END AS verdict,
       r.pattern, r.category, coalesce(r.n, 0) AS n_active
FROM u LEFT JOIN r ON u.page_id = r.page_id AND r.k = 1
"""


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op6_line_dedup"] = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM s),
k AS (SELECT doc_id, pos, line, {_AZ.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
f AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keep AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


_SP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

ORACLES["op7_mixing"] = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, 3e0 * n / w AS ratio, row_number() OVER (ORDER BY 3e0 * n / w, source NULLS LAST) AS k FROM s),
c AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) - 3 * coalesce(sum(n) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS share
      FROM r WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(k) AS k FROM c WHERE NOT CAST(rest AS DOUBLE) * w / CAST(share AS DOUBLE) > 3 * n),
t AS (SELECT source, n, CASE WHEN k < (SELECT k FROM f) THEN 3e0 * n
             ELSE (SELECT CAST(rest AS DOUBLE) FROM c WHERE k = (SELECT k FROM f)) * w / (SELECT CAST(share AS DOUBLE) FROM c WHERE k = (SELECT k FROM f)) END AS target FROM c),
g AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target + 0.5e0) AS BIGINT) // n ELSE 0 END AS passes, CASE WHEN n > 0 THEN CAST(floor(target + 0.5e0) AS BIGINT) % n ELSE 0 END AS part FROM t),
o AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('17:' || doc_id), 1, 15))::BIGINT, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d),
m AS (SELECT doc_id, size, n AS source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE passes + CAST(part > 0 AND 2 * ahead + size <= 2 * part AS INTEGER) END AS BIGINT) AS copies
      FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM m
"""


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("text_key")


# Every pair that shares a shingle, and the smallest id that links reach.
ORACLES["op8_minhash_near_dedup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_AZ.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) END) AS g FROM w),
c AS (SELECT doc_id, hash(g) AS g, count(*) AS n FROM s GROUP BY doc_id, hash(g)),
t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS n FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT i.a, i.b FROM i JOIN t x ON x.doc_id = i.a JOIN t y ON y.doc_id = i.b WHERE i.n >= 0.8e0 * (x.n + y.n - i.n) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b),
m AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS lead FROM m
"""


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


# For pages whose article stands in one article element, as those of the test tables; other layouts have tests.
ORACLES["op9_html_text"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(p|h[1-6]|br|li|ul|ol|div|section|blockquote|pre)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(regexp_replace(t, '&quot;?', '"', 'g'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), texts=False)


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_RULES = rules.QualityRules()
_MARKED = "[!?.,;:#*$%&|<>~=_+^@-]{2}"

ORACLES["op10_quality_rules"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_WORDS.format("text")} AS ws FROM t),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS k, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) AS gram FROM w WHERE len(ws) > 5),
h AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g),
p AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM h, range(5) r(j) WHERE times > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
b AS (SELECT doc_id, pos, line, trim(line, {_SP}) AS bare, {_WORDS.format("line")} AS ws FROM l),
v AS (SELECT doc_id, pos, line, list_sum(list_transform(ws, lambda x: length(x))) AS chars,
        row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again,
        NOT right(rtrim(bare, {_quoted([rules.CLOSING])}), 1) IN ({_quoted(rules.TERMINAL)})
        OR len(list_filter(ws, lambda x: regexp_matches(x, '{_MARKED}'))) > {_RULES.max_marked}e0 * len(ws)
        OR len(list_filter(ws, lambda x: x IN ({_quoted(rules.SEPARATORS)}))) > {_RULES.max_separators}e0 * len(ws)
        OR (len(ws) <= {_RULES.boilerplate_words} AND regexp_matches({_AZ.format("bare")}, {_quoted([rules.BOILERPLATE])})) AS gone
      FROM b WHERE len(ws) > 0),
q AS (SELECT doc_id, count(*) FILTER (WHERE again) AS dup, count(*) FILTER (WHERE gone) AS removed, coalesce(sum(chars) FILTER (WHERE gone), 0) AS lost FROM v GROUP BY doc_id),
a AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(q.dup, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
        coalesce(q.removed, 0) AS n_removed_lines, CAST(coalesce(q.lost, 0) AS BIGINT) AS lost
      FROM w LEFT JOIN p ON p.doc_id = w.doc_id LEFT JOIN q ON q.doc_id = w.doc_id),
z AS (SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars - lost >= {_RULES.min_kept}e0 * word_chars AS kept, n_removed_lines, word_chars - lost AS kept_chars FROM z
"""


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(encoded(*rebuilt(read(spark, sf_dir, "conversations"))))


#: The 256 steps of CRC-32, and the checksum of a string by them (`tab` must be among the tables).
_CRC_TAB = """tab AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i)))"""


def _crc(s: str) -> str:
    octets = f"list_transform(range(1, octet_length(encode({s})) + 1), lambda i: ('0x' || substr(hex(encode({s})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295] || {octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLES["op11_conversation_trie"] = rf"""
WITH {_CRC_TAB},
t0 AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
t1 AS (SELECT *, sha256(octet_length(encode(r)) || ':' || r || x) AS g, len(regexp_extract_all(x, '[^ 	-
]+')) AS w FROM t0),
t AS (SELECT c, g, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, g) - 1 AS pos FROM t1),
ids AS (SELECT c, {_crc("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM t0), tab),
s AS (SELECT ids.c, t.pos, t.g, t.w FROM ids JOIN t ON t.c = ids.c AND t.pos >= h
      UNION ALL SELECT ids.c, t.pos, t.g, t.w FROM ids JOIN t ON t.c = ids.c - ids.c % 20 AND t.pos < h),
q AS (SELECT ids.c, coalesce(list(g ORDER BY pos) FILTER (g IS NOT NULL), []) AS g, coalesce(list(w ORDER BY pos) FILTER (g IS NOT NULL), []) AS w
      FROM ids LEFT JOIN s ON s.c = ids.c GROUP BY ids.c),
m0 AS (SELECT c, g, w, len(g) AS n, unnest(range(0, len(g) + 1)) AS d FROM q),
m AS (SELECT c, n, d, sha256(d || ':' || array_to_string(g[1:d], ',')) AS k, CASE WHEN d > 0 THEN sha256((d - 1) || ':' || array_to_string(g[1:d - 1], ',')) END AS up,
             CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w FROM m0),
node AS (SELECT k, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n, any_value(w) AS w, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM m GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS kids FROM node WHERE up IS NOT NULL GROUP BY up),
full_node AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (k)),
under AS (SELECT m.k, count(*) FILTER (f.kids = 0) AS leaves, sum((f.n - 1) * f.w) AS saved FROM full_node f JOIN m ON m.c = f.conv_id AND m.d <= f.d GROUP BY m.k)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_node f JOIN under u ON u.k = f.k LEFT JOIN node p ON p.k = f.up
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(read(spark, sf_dir, "documents"), min_chars=6, min_count=5, every=199), factor=5, min_chars=6)


ORACLES["op12_spelling_variants"] = rf"""
WITH RECURSIVE {_CRC_TAB},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, {_AZ.format("unnest(regexp_extract_all(text, '[A-Za-z" + chr(0xC0) + "-" + chr(0xFF) + "]+'))")} AS w FROM documents),
d AS (SELECT doc, w, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT *, {_crc("doc || ':' || w")} AS h FROM d, tab),
words AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n)::BIGINT AS n
          FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
      FROM words LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root FROM words UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n
FROM f JOIN up ON up.word = f.word JOIN f AS e ON e.word = up.root AND e.form IS NULL
"""


@query
def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return record_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
