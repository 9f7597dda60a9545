"""Stages of the pipeline, each against its own input, on the smallest table."""

import re
from collections import Counter

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from imagelake.llm import quality, sentencepieces
from imagelake.llm.common import table
from imagelake.llm.queries import ORACLES

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(table(stage(spark, out[-1], SF), name.replace(" ", "-")))
    return [d.toPandas() for d in out]


def test_columns(steps):
    assert all(list(d.columns) == list(corpus_pipeline.COLUMNS) for d in steps[:-1])


def test_each_stage(steps):
    docs, clean, unique, far, mixed, ids = steps
    assert set(clean.doc_id) <= set(docs.doc_id) and len(clean) > 0.5 * len(docs)
    by_text = clean.assign(k=[t.encode().lower() for t in clean.text]).groupby("k").doc_id.max()
    assert sorted(unique.doc_id) == sorted(by_text)
    grams = {}
    for i, t in zip(far.doc_id, far.text, strict=True):
        w = t.encode().lower().split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    keys = list(grams)
    assert not any(len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) for n, a in enumerate(keys) for b in keys[:n])
    assert set(mixed.doc_id) <= set(far.doc_id) and max(Counter(mixed.doc_id).values()) <= 3
    assert Counter(ids.doc_id) == Counter(mixed.doc_id) and ids.round_trip.all()


def test_stages_tell_repeated_ids_apart(spark):
    long = "this is a text that is long enough to have shingles of its own and more words"
    rows = [(1, long, "en", "a", 9), (1, long, "en", "a", 9), (1, "another text of the same id that has words of its own in it", "en", "b", 9), (None, long.upper(), None, None, 9), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text or "" for r in corpus_pipeline.exact(spark, docs, SF).collect()) == ["", rows[2][1], long]
    assert sorted(r.text or "" for r in corpus_pipeline.near(spark, docs, SF).collect()) == ["", rows[2][1], long]
    mixed = Counter((r.doc_id, r.text) for r in corpus_pipeline.source_mix(spark, docs, SF).collect())
    assert set(mixed) <= {r[:2] for r in rows} and mixed and (None, None) not in mixed


def rows_of(d, columns=corpus_pipeline.COLUMNS):
    """Rows as a multiset; missing values are None."""
    return Counter(tuple(None if v is None or v != v else v for v in r) for r in d[list(columns)].itertuples(index=False))


def fails(line):
    """The line rules of imagelake.llm.quality, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    bare = line.strip(" \t\n\x0b\x0c\r").rstrip(quality.CLOSING)
    marked = sum(bool(re.search(r"[!?.,;:#*$%&|<>~=_+^@-]{2}", w)) for w in words)
    between = sum(w in quality.SEPARATORS for w in words)
    lower = "".join(c.lower() if c.isascii() else c for c in line)
    stock = len(words) <= 25 and re.search(quality.BOILERPLATE, lower.strip(" \t\n\x0b\x0c\r"))
    return bool(words) and (not bare.endswith(tuple(quality.TERMINAL)) or marked > 0.3 * len(words) or between > 0.2 * len(words) or bool(stock))


def test_each_stage_keeps_whole_rows(steps):
    """The rows of each stage in full, against SQL or brute force over its input."""
    docs, clean, unique, far, mixed, ids = steps
    con = duckdb.connect()

    def sql(name, table):
        con.register("documents", table)
        return {r[0]: r[1] for r in con.execute(f"SELECT doc_id, {name[1]} FROM ({ORACLES[name[0]]})").fetchall()}

    assert docs.doc_id.is_unique and docs.doc_id.notna().all()  # rows are told apart by id below
    kept, want = sql(("op10_quality_rules", "kept"), docs), Counter()
    for r in docs.itertuples():
        if kept[r.doc_id]:
            text = "\n".join(x for x in (r.text or "").split("\n") if not fails(x))
            want[r.doc_id, text, r.lang, r.source, len(text)] += 1
    assert rows_of(clean) == want and any(kept.values()) and not all(kept.values())

    last = clean.assign(k=[t.translate(AZ) for t in clean.text]).groupby("k").doc_id.max()
    assert rows_of(unique) == rows_of(clean[clean.doc_id.isin(last)])

    grams, root = {}, {}
    for i, t in sorted(zip(unique.doc_id, unique.text, strict=True)):
        w = t.encode().lower().split()
        grams[i], root[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set(), i
    find = lambda i: i if root[i] == i else find(root[i])
    for n, a in enumerate(grams):
        for b in list(grams)[:n]:
            if grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert rows_of(far) == rows_of(unique[[find(i) == i for i in unique.doc_id]])

    copies = sql(("op7_mixing", "copies"), far)
    assert rows_of(mixed) == Counter({r: n for r in rows_of(far) if (n := copies[r[0]])}) and len(mixed)

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    got = Counter((r.doc_id, r.lang, r.source, tuple(r.ids), r.n_ids) for r in ids.itertuples())
    assert got == Counter((r.doc_id, r.lang, r.source, tuple(e := library.encode(r.text)), len(e)) for r in mixed.itertuples())


def test_stages_take_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0, name
        assert name == "sentencepiece" or out.columns == list(corpus_pipeline.COLUMNS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    """Each query that has SQL, on the smallest tables."""
    from imagelake.llm.queries import QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    made = QUERIES[name](spark, SF)
    assert sorted(made.columns) == sorted(columns)
    same = lambda v: "" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    assert Counter(tuple(map(same, r)) for r in made.select(*columns).collect()) == Counter(tuple(map(same, r)) for r in want.fetchall())
