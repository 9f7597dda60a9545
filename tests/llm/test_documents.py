"""Operators over documents against brute force, on fixtures with every awkward case."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from imagelake.llm import exactdedup, langid, linededup, minhash, mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, entry long, size long, pattern string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    rng = random.Random(4)
    rows = []
    shared = "This licence line is shared by very many of the documents here."
    for i in range(60):
        text = "\n".join(sentence(rng, rng.randint(6, 14)).capitalize() + "." for _ in range(rng.randint(2, 5)))
        if i % 3 == 0:
            text += "\n  " + (shared.upper() if i % 2 else shared) + "\t"
        rows.append((i, text, "en" if i % 2 else None, f"s{i % 4}" if i % 7 else None))
    base = sentence(rng, 120)
    for i in range(60, 75):  # near copies: one word of the base is another
        words = base.split()
        words[(i * 11) % 120] = "changed"
        rows.append((i, " ".join(words), "en", "s0"))
    rows += [(75, base.upper(), "en", "s0"), (76, base, "en", "s1"), (76, base, "en", "s1"), (77, "", "de", "s2"), (78, None, None, None)]
    rows += [(None, "A text without an id that is long enough to be kept here, it has words.", "en", "s1"), (None, base, "fr", "s2")]
    rows += [(79, "É " + base, "en", "s1"), (80, "x" * 70_000 + " end", "en", "s1"), (81, (sentence(rng, 40) + ".\n") * 200, "en", "s3")]
    rows += [(82, "\n \n\t", "en", "s1"), (83, "one two", "en", "s1"), (84, "one two", "en", "s2"), (85, "\x0b\x0c\r\x1f  odd\x85white\xa0space", "en", "s2")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(a, b, c, d, len(b or ""), 1, 2, "p") for a, b, c, d in corpus()]  # the last columns' names clash with inner ones
    return spark.createDataFrame(rows, SCHEMA).repartition(5, F.col("text")).cache()


def lower(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("digest_bytes,max_rows", [(32, 20_000), (1, 7), (32, 3)])
@pytest.mark.parametrize("keep", ["first", "last"])
def test_exact_dedup(docs, keep, digest_bytes, max_rows):
    out = exactdedup.exact_dedup(docs, keep, max_rows=max_rows, digest_bytes=digest_bytes).collect()
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[lower(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "first" else max)(known) if known else None
        for i in ids:
            want[i, best, len(ids), hashlib.sha256(t).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("keep", ["first", "last"])
def test_exact_dedup_of_extreme_ids(spark, keep):
    low, high = -(2**63), 2**63 - 1
    ids = {"a": [low, high, 0, None], "b": [low, None], "c": [high, high], "d": [-high, None], "e": [None, None], "f": [-1, 0]}
    rows = [(i, t) for t, group in ids.items() for i in group]
    out = exactdedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), keep, max_rows=2).collect()
    best = {t: (min if keep == "first" else max)((i for i in g if i is not None), default=None) for t, g in ids.items()}
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in ids}
    assert Counter((r.doc_id, sha[r.text_sha256], r.keep_id, r.group_size) for r in out) == Counter((i, t, best[t], len(ids[t])) for i, t in rows)
    assert Counter(sha[r.text_sha256] for r in out if r.kept) == Counter(ids.keys()) and all(r.doc_id == r.keep_id for r in out if r.kept)


def test_runs_find_their_digests(tmp_path):
    rng = random.Random(8)
    table = exactdedup.Memtable(0, f"file://{tmp_path}", True, 10**9, 10**9, 1)  # digests of one byte: many collide
    texts = [str(rng.randrange(3000)).encode() for _ in range(6000)]
    rows = []
    for i, t in enumerate(texts):
        table.add(i, 0, t)
        if i % 900 == 899:
            rows += [r for b in table.flush() for r in b.to_pylist()]
    rows += [r for b in table.flush() for r in b.to_pylist()]
    entries = defaultdict(set)
    for r in rows:
        entries[texts[r["doc_id"]]].add(r["entry"])
    assert len(rows) == 6000 and all(len(v) == 1 for v in entries.values()) and len({e for v in entries.values() for e in v}) == len(entries)
    assert sum(r["path"] is not None for r in rows) == len(entries) and {r["seq"] for r in rows} == set(range(6000))
    full = exactdedup.Filter([hashlib.sha256(t).digest() for t in set(texts)])
    assert all(full.passes(hashlib.sha256(t).digest()) for t in texts)
    assert sum(full.passes(hashlib.sha256(b"x%d" % i).digest()) for i in range(3000)) < 150


def test_line_dedup(docs):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in linededup.line_dedup(docs, 40, 5).collect())
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    for i, t, *_ in corpus():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    keep = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    want = Counter()
    for i, t, *_ in corpus():
        lines = (t or "").split("\n")
        left = [x for x in lines if not (key(x) in keep and keep[key(x)] != i)]
        want[i, len(lines), len(lines) - len(left), "\n".join(left)] += 1
    assert got == want and any(k[2] for k in want)


def test_quality_base_figures(docs):
    out = quality.quality(docs, texts=False).collect()
    want = Counter()
    for i, t, *_ in corpus():
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        many = Counter(windows)
        hit = {k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        want[i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert not any(r.kept and r.base_failed for r in out)


@pytest.mark.parametrize(
    "line,verdict",
    [
        ("This is a plain sentence.", None), ("She asked: »Is it so?«", None), ("no end mark here", "punctuation"), ("Buy!! now!! this!! is!! it!!", "punctuation"),
        ("Home | News | Sport | About .", "navigation"), ("Copyright 2020. All rights reserved.", "boilerplate"), ("Released under the MIT License.", "boilerplate"),
        ("Dieses Werk ist lizenziert unter CC BY-SA 4.0.", "boilerplate"), ("Alle Rechte vorbehalten.", "boilerplate"), ("Tous droits réservés.", "boilerplate"),
        ("Cette œuvre est mise à disposition sous licence CC BY.", "boilerplate"), ("Todos los derechos reservados.", "boilerplate"), ("Publicado bajo la licencia MIT.", "boilerplate"),
        ("Ce site utilise des cookies.", "boilerplate"), ("We use cookies to make this site better.", "boilerplate"), ("Diese Website verwendet Cookies.", "boilerplate"), ("Este sitio utiliza cookies.", "boilerplate"),
        ("Log in to read on.", "boilerplate"), ("Impressum und Datenschutzerklärung.", "boilerplate"), ("Some notes by the team, all rights reserved 2021.", "boilerplate"),
        ("The court held that the copyright had expired in 1950.", None), ("I do not subscribe to that view.", None), ("She had to log in again before noon.", None),
        ("You can read more about the war in his diary.", None), ("Das Impressum fehlt auf dieser Seite.", None), ("The old firm kept all its papers and held all rights reserved to it.", None), ("Die Rechte der Bürger sind wichtig.", None), ("Les droits de tous sont importants.", None), ("Los derechos son de todos.", None),
    ],
)
def test_line_rules(line, verdict):
    assert quality.line_fails(line.encode(), line.encode().split(), quality.QualityRules()) == verdict


@pytest.mark.parametrize("marks", [22, 63, 64, 65, 400])
def test_line_rules_look_behind_all_closing_marks(marks):
    for mark in "\"”)":
        for line, verdict in (("This is a plain sentence." + mark * marks, None), ("no end mark here" + mark * marks, "punctuation"), (mark * marks, "punctuation")):
            assert quality.line_fails(line.encode(), line.encode().split(), quality.QualityRules()) == verdict


def test_quality_removes_lines_and_rejects(spark):
    good = "The first sentence of it all is here and stays.\nThe second one is also fine, and it is long."
    rows = [(1, good + "\nHome | News | Sport | About ."), (2, "no end\nmarks at all\nin these lines\n" * 5 + "One good line is here."), (3, None)]
    out = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].kept and out[1].clean_text == good and out[1].n_removed_lines == 1
    assert not out[2].kept and not out[3].kept and out[3].n_words == 0


def similar(x, y):
    """Weighted Jaccard similarity of two counters."""
    return sum((x & y).values()) / sum((x | y).values())


def shingled(text):
    w = lower(text).split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def classes_of(sets, threshold=0.8):
    """The smallest place of each set's class."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and similar(sets[i], sets[j]) >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def brute_classes(threshold=0.8):
    rows = corpus()
    groups = defaultdict(list)
    for r, c in zip(rows, classes_of([shingled(t) for _, t, *_ in rows], threshold), strict=True):
        groups[c].append(r[0])
    out = Counter()
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        for i in ids:
            out[i, min(known) if known else None, len(ids)] += 1
    return out, len(groups)


def test_near_duplicates(docs):
    out = minhash.near_duplicates(docs).collect()
    want, classes = brute_classes()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in out) == want
    assert sum(r.lead for r in out) == classes


def test_dart_minhash_estimates_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(3)
    e = rng.integers(0, 2**63, 300, dtype=np.uint64)
    w1 = rng.uniform(0.2, 6, 300)
    w2 = w1 * rng.uniform(0.4, 1.6, 300)
    same = (minhash.dart_minhash(e, 2000, w1) == minhash.dart_minhash(e, 2000, w2)).mean()
    assert abs(same - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.05
    assert (minhash.dart_minhash(e[::-1].copy(), 64) == minhash.dart_minhash(e, 64)).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(600, i) for i in range(601, 660)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(parent[a], parent[b])
            if parent[a] != m or parent[b] != m:
                parent[a] = parent[b] = m
                changed = True
    assert got == parent


def test_mixing(spark, docs):
    out = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, _, s in corpus():
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    goal = mixing.targets(sizes)
    taken = Counter()
    for r in out:
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.sources[0]] and r.target == pytest.approx(goal[r.sources[0]])
        taken[r.sources[0]] += r.taken
    largest = max(r.size for r in out)
    assert all(abs(taken[s] - goal[s]) <= largest for s in sizes)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))


@pytest.mark.parametrize("ids", ["repeated", "missing"])
def test_mixing_is_the_same_in_any_layout(spark, ids):
    rows = [(None if ids == "missing" else i % 7, "w " * (i % 23 + 1) + str(i % 150), "ab"[i % 2], i) for i in range(400)]
    found = set()
    for order, parts in ((1, 1), (-1, 5), (7, 3)):
        df = spark.createDataFrame(sorted(rows, key=lambda r: r[3] * order % 401), "doc_id long, text string, source string, n int").repartition(parts)
        out = mixing.mix(df).select("doc_id", "text_key", "sources", "taken", "copies").collect()
        found.add(tuple(sorted(map(str, out))))
    assert len(found) == 1


def test_targets_stop_at_three_times():
    goal = mixing.targets({"a": 1000, "b": 10, "c": 1000, None: 5})
    assert goal["b"] == 30 and goal[None] == 15 and sum(goal.values()) == pytest.approx(2015)
    assert goal["a"] * 3 == pytest.approx(goal["c"])  # weights 1 and 3


def test_min_cost_flow_prefers_first_passes_and_shares_overlaps():
    given = mixing.min_cost_flow({("a",): 100, ("b",): 100, ("a", "b"): 100}, {"a": 150, "b": 150}, 3)
    assert given == {("a",): 100, ("b",): 100, ("a", "b"): 100}
    given = mixing.min_cost_flow({("a",): 100, ("a", "b"): 50}, {"a": 220, "b": 60}, 3)
    assert sum(given.values()) == 280 and given["a",] >= 100


def all_flows(patterns, quota, most):
    """The largest flow and its least cost, by trying every way to give words."""
    import itertools

    arcs = [(p, s) for p in patterns for s in p]
    best = (0, 0)
    for words in itertools.product(*(range(most * patterns[p] + 1) for p, _ in arcs)):
        given, got = Counter(), Counter()
        for (p, s), n in zip(arcs, words):
            given[p] += n
            got[s] += n
        if all(given[p] <= most * n for p, n in patterns.items()) and all(got[s] <= q for s, q in quota.items()):
            cost = sum(sum(k * (k + 1) // 2 * min(max(given[p] - k * n, 0), n) for k in range(most)) for p, n in patterns.items())
            best = max(best, (sum(words), -cost))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_min_cost_flow_against_every_flow(seed):
    rng = random.Random(seed)
    patterns = {p: rng.randint(1, 2) for p in [("a",), ("a", "b"), ("b", "c"), ("c",)][: rng.randint(2, 4)]}
    quota = {s: rng.randint(0, 7) for p in patterns for s in p}
    given = mixing.min_cost_flow(patterns, quota, 3)
    cost = sum(sum(k * (k + 1) // 2 * min(max(given[p] - k * n, 0), n) for k in range(3)) for p, n in patterns.items())
    assert (sum(given.values()), -cost) == all_flows(patterns, quota, 3)


def test_mixing_of_overlapping_sources(spark):
    """Words that each set of sources gives, against the flow; documents of a part are the first in the seeded order."""
    rng = random.Random(6)
    tags = [["x"], ["y"], ["x", "y"], ["z", "x"], ["z"], [], None]
    rows = [(i, " ".join("w" * rng.randint(0, 9)), rng.choice(tags[:4] if i % 5 else tags)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>").repartition(5)
    out = mixing.mix(df, sources=F.col("tags")).collect()
    size, taken, sizes = Counter(), Counter(), Counter()
    for _, t, s in rows:
        for name in [key := tuple(sorted(set(s or [None]), key=str))] and key:
            sizes[name] += len(t.split())
        size[key] += len(t.split())
    goal = mixing.targets(sizes)
    goal = {s: t * sum(size.values()) / sum(sizes.values()) for s, t in goal.items()}
    size = dict(sorted(size.items(), key=lambda kv: json.dumps(kv[0], separators=(",", ":"))))
    given = mixing.min_cost_flow(size, {s: int(t + 0.5) for s, t in goal.items()}, 3)
    assert len(out) == 400
    for r in out:
        taken[tuple(r.sources)] += r.taken
        assert r.taken == r.copies * r.size <= 3 * r.size and r.target == pytest.approx(goal[r.sources[0]])
    assert set(taken) == set(size) and all(abs(taken[p] - given[p]) <= 9 for p in size)
    order = lambda r: int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:15], 16)
    for p in size:
        copies = [r.copies for r in sorted((r for r in out if tuple(r.sources) == p and r.size), key=order)]
        assert copies == sorted(copies, reverse=True)


def test_language_id_on_a_fixture(spark):
    en = ["the cat sat on the mat and the dog is here", "this is what they said about the house", "we have been there with them"]
    de = ["der hund ist nicht auf dem tisch und die katze", "das ist ein haus mit einem garten", "wir sind nicht dort gewesen und ich auch nicht"]
    rows = [(i, (en if i % 2 else de)[i % 3] + f" {i}", "en" if i % 2 else "de", 1) for i in range(60)]
    rows += [(60, None, "en", 1), (61, "", "de", 1), (62, "123 !? 45", "en", 1), (63, "the dog is on the table", None, 1), (None, "das haus ist nicht hier", "de", 1), (64, "die katze " * 90_000, None, 1)]
    out = {r.doc_id: r for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")).collect()}
    assert len(out) == 66
    assert [out[i].lang_pred for i in (60, 61, 62)] == ["und"] * 3 and out[60].score == 0
    assert out[63].lang_pred == "en" and out[None].lang_pred == "de" and not out[None].held_out and out[64].lang_pred == "de"
    assert all(out[i].lang_pred == ("en" if i % 2 else "de") for i in range(60)) and all(0 <= r.score <= 1 for r in out.values())


def plain_features(text, bits, orders):
    """Counts of hashed byte n-grams, one by one."""
    folded = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text)
    total = [0] * (1 << bits)
    for n in orders:
        for i in range(len(folded) - n + 1):
            code = int.from_bytes(folded[i : i + n], "big") ^ (n * 0x3C6EF372 & 0xFFFFFFFF)
            total[(code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)] += 1
    return [(v / max(1, sum(total))) ** 0.5 for v in total]


def test_language_id_against_plain_loops(spark):
    """Predictions for every document of the smallest table, by sums over n-grams and bits; held-out accuracy."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs.filter("lang is not null and text is not null").filter(~langid.held_out()).select("doc_id", "text", "lang"))
    f, trust = langid.Features(), model.trust / model.trust.sum()
    out = {r.doc_id: r for r in langid.language_id(docs).collect()}
    for r in docs.collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (out[r.doc_id].lang_pred, out[r.doc_id].score) == ("und", 0)
            continue
        x = plain_features(r.text.encode(), f.bits, f.orders)
        used = [i for i, v in enumerate(x) if v]
        margins = [sum(x[i] * float(model.weights[i, bit]) for i in used) + float(model.bias[bit]) for bit in range(len(trust))]
        loss = [sum(t * math.log1p(math.exp(-c * m)) for t, c, m in zip(trust, code, margins)) for code in model.code]
        best = min(range(len(loss)), key=loss.__getitem__)
        score = 1 / sum(math.exp(-(v - loss[best]) * len(trust)) for v in loss)
        assert out[r.doc_id].lang_pred == model.languages[best] and out[r.doc_id].score == pytest.approx(score, abs=1e-3)


def test_language_id_accuracy_by_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.filter("lang is not null").collect()}
    right, of = Counter(), Counter()
    for r in langid.language_id(docs).filter("held_out and lang_pred != 'und'").collect():
        if r.doc_id in truth:
            of[truth[r.doc_id]] += 1
            right[truth[r.doc_id]] += r.lang_pred == truth[r.doc_id]
    assert len(of) >= 4 and all(right[k] >= 0.97 * of[k] for k in of)


def test_language_id_sample_is_bounded(spark, monkeypatch):
    rows = [(i, f"text of language {i % 40} with words {i}", f"l{i % 40:02d}") for i in range(2000)]
    sizes = []
    fit = langid.Classifier.fit
    monkeypatch.setattr(langid.Classifier, "fit", staticmethod(lambda x, y, names: sizes.append((len(x), len(names))) or fit(x, y, names, steps=2)))
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=400)
    assert sizes[0][1] == 40 and 200 < sizes[0][0] <= 400


def test_language_id_without_labels(spark):
    rows = [(1, "some text", None), (2, None, None)]
    out = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in out} == {"und"}


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n and (abs(code.sum(0)) < n).all()


@pytest.mark.parametrize("run", [exactdedup.exact_dedup, linededup.line_dedup, quality.quality, minhash.near_duplicates, mixing.mix, langid.language_id])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def changed(n, words, most, seed):
    """Copies of one text with 1 to `most` words changed: they link to some others only, so pivots don't settle it."""
    rng = random.Random(seed)
    base = [rng.choice(WORDS) + str(i) for i in range(words)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(1, most)):
            copy[rng.randrange(words)] = f"w{rng.randrange(10_000)}"
        texts.append(" ".join(copy))
    return texts


def test_near_duplicates_around_the_threshold(spark):
    texts = changed(120, 150, 7, 11)
    want = classes_of(list(map(shingled, texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts, options in ((3, {}), (1, {"draws": 1}), (7, {"draws": 1, "block_bytes": 4000})):
        got = {r.doc_id: (r.class_id, r.class_size) for r in minhash.near_duplicates(df.repartition(parts), **options).collect()}
        assert got == {i: (want[i], want.count(want[i])) for i in range(120)}


def test_near_duplicates_weigh_repeated_shingles(spark):
    """Equal sets of shingles are no duplicates where counts differ much, and counts link what sets alone don't."""
    line, tail = "one two three four five six seven eight nine ten", " ".join(f"x{i}" for i in range(12))
    texts = [line, " ".join([line] * 30), " ".join([line] * 33), " ".join([line] * 60), f"{line} {tail}", f"{' '.join([line] * 30)} {tail}", "a " * 3000, "a " * 3500, "a " * 5000]
    want = classes_of(list(map(shingled, texts)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want == [0, 1, 1, 3, 4, 1, 6, 6, 8]


def test_near_duplicates_write_links_only(spark, monkeypatch):
    """However many cells outsiders and members fill, pairs of a cell are no rows and nothing goes through the driver."""
    df = spark.createDataFrame(list(enumerate(changed(90, 150, 7, 5))), "doc_id long, text string")
    verified, pairs = minhash.verified, []
    monkeypatch.setattr(minhash, "verified", lambda p, s: pairs.append(p.count()) or verified(p, s))
    few = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    n = len(pairs)
    many = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, block_bytes=1500).collect()}
    assert few == many and pairs[:n] == pairs[n:] and max(pairs) <= 28 * 90


def test_near_duplicates_equal_brute_force_on_the_corpus(spark):
    """All documents of the sf0.01 table; recall over pairs and classes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets, holders, root = [shingled(t) for _, t in rows], defaultdict(list), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = []
    for n, s in enumerate(sets):
        for m in {m for g in s for m in holders[g]}:
            if similar(s, sets[m]) >= 0.8:
                links.append((rows[m][0], rows[n][0]))
                a, b = find(rows[m][0]), find(rows[n][0])
                root[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(n)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert links and all(got[a] == got[b] for a, b in links)
    assert got == {i: find(i) for i, _ in rows}
