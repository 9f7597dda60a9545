"""Conversation trie, spelling variants and record files, against plain versions."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from imagelake.llm import recordfiles, turntrie, variants

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- conversation trie


def plain_trie(rows):
    """rows: (conv_id, turn, role, text) -> Counter of node rows, by every prefix of every conversation."""
    convs, out = defaultdict(list), Counter()
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: tuple(t[2:] for t in sorted(v, key=lambda t: (t[0], t[1], t[2], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))) for c, v in convs.items()}
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, own in members.items():
        words = len(k[-1][1].translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ")) - k[-1][1].translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ").count("") if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(own) - 1) * words
    for k, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if seqs[c] == k)
        out[min(own), len(k), min(members[k[:-1]]) if k else None, len(own), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def conversations(seed=0, n=160):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        prefix = [("system", "be kind to all")] * 3 + [("user", f"a\x0bb \x1cc {i}") for i in range(c % 3)]
        tail = [("user", "w " * r.randint(0, 3)) for _ in range(r.randint(0, 4))] if c % 4 else []
        rows += [(c - 50, i, *t) for i, t in enumerate(prefix + tail)]
    rows += [(900, None, None, None), (900, None, "", ""), (900, 1, "user", "x" * 100_000), (None, 0, "user", "lost"), (901, 5, "b", "1"), (901, 5, "a", "2"), (901, 5, "a", "2")]
    rows += [(1000 + k, i, "user", f"deep {i}") for k in range(3) for i in range(60)] + [(1001, 99, "user", "more")]
    return rows


@pytest.mark.parametrize(("most", "size"), [(4096, 1 << 20), (3, 1 << 20), (4096, 30)])
def test_trie_equals_all_prefixes(spark, most, size):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string").repartition(3)
    got = turntrie.conversation_trie(turntrie.encoded(turntrie.turn_digests(df)), most, size)
    assert Counter(map(tuple, got.collect())) == plain_trie(rows)


def test_trie_of_one_turn_and_of_none(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turntrie.conversation_trie(turntrie.encoded(*turntrie.rebuilt(empty))).collect() == []
    one = spark.createDataFrame([(7, 0, "u", "hi you")], "conv_id long, turn long, role string, text string")
    rows = [tuple(r) for r in turntrie.conversation_trie(turntrie.encoded(turntrie.turn_digests(one))).orderBy("depth").collect()]
    own = hashlib.sha256(b"7").hexdigest()
    assert rows == [(7, 0, None, 1, 1, 1, 0, turntrie.EMPTY), (7, 1, 7, 1, 0, 1, 0, own)]


def test_rebuilt_conversations(spark):
    rows = [(c, i, "u", f"{c}:{i}") for c in (*range(20, 45), -7, -20, 61) for i in range(c % 5 + 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own = defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role, text))
    want = []
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        want += [(c, i, *t) for i, t in enumerate(own.get(base, [])[:h] + turns[h:])] or [(c, None, None, None)]
    got = turntrie.conversation_trie(turntrie.encoded(*turntrie.rebuilt(df)), 3).collect()
    turnless = {c for c, i, *_ in want if i is None}
    nodes = plain_trie([w for w in want if w[0] not in turnless])
    root = [r for r in got if r.depth == 0]
    assert len(root) == 1 and root[0].n_convs == len(own) and root[0].conv_id == min(own)
    assert root[0].ends_sha256 == hashlib.sha256(",".join(map(str, sorted(turnless))).encode()).hexdigest()
    drop = lambda r: (*r[:2], *r[3:])  # noqa: E731  a parent's name may be that of a turnless member of the root
    assert Counter(drop(tuple(r)) for r in got if r.depth) == Counter(drop(k) for k in nodes if k[1])


def test_trie_member_lists_in_parts(spark):
    rows = [(c, 0, "u", "same") for c in range(25_000)] + [(c, 0, "u", f"own {c}") for c in range(25_000, 25_050)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = turntrie.conversation_trie(turntrie.encoded(turntrie.turn_digests(df)), 8).filter("n_convs = 25000").collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(map(str, range(25_000))).encode()).hexdigest()]


# ---------------------------------------------------------------- spelling variants


def plain_variants(counts, factor=5):
    near = {w: [v for v in counts if variants.is_near(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("block", [3, 12, 2048])
def test_variants_equal_all_comparisons(spark, block):
    r = random.Random(block)
    words = {"".join(r.choice("abÿ") for _ in range(r.randint(6, 9))) for _ in range(500)} | {"x" * 400, "x" * 399, "x" * 200 + "y" + "x" * 199, "ab", "b", "a"}
    counts = {w: r.choice([1, 2, 5, 30, 160, 5000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert {tuple(x) for x in variants.spelling_variants(df, 5, block).collect()} == plain_variants(counts)


def test_one_edit():
    near = [("abc", "abd"), ("abc", "ab"), ("ab", "abc"), ("bc", "abc"), ("", "a"), ("aab", "ab")]
    far = [("abc", "abc"), ("abc", "bcd"), ("abc", "acb"), ("a", "abc"), ("abcd", "bcde"), ("", "ab")]
    assert all(variants.is_near(a, b) and variants.is_near(b, a) for a, b in near) and not any(variants.is_near(a, b) for a, b in far)


def test_word_counts(spark):
    r = random.Random(5)
    texts = [(i, " ".join("".join(r.choice("abcÀÿ÷") for _ in range(r.randint(2, 9))) + r.choice(["", ",", "Ā", "9"]) for _ in range(400))) for i in range(60)]
    texts += [(None, "Qwerty Qwerty"), (3, None), (4, ""), (5, "ABCÉabc " * 40_000), (6, "z" * 300_000)]
    want = Counter()
    for doc, text in texts:
        run = ""
        for c in [*(text or ""), " "]:
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
                run = ""
    df = spark.createDataFrame([(*t, 9) for t in texts], "doc_id long, text string, n int").repartition(3)
    assert {tuple(x) for x in variants.word_counts(df, 3, 2).collect()} == {(w, n) for w, n in want.items() if len(w) >= 3 and n >= 2}
    assert variants.spelling_variants(variants.word_counts(df.limit(0))).collect() == []


# ---------------------------------------------------------------- record files


def documents():
    r = random.Random(8)
    sign = "aB'sS tTlLdDrReE019²ªµßéÉİıŉǅȺ  \n\t\r\x0b\x0c\x1c\x85\xa0.,;-́’　漢ΑΣ<|>"
    texts = ["".join(r.choice(sign) for _ in range(r.randint(0, 80))) for _ in range(300)] + ["I'll <|endoftext|>go", "word " * 30_000, "x" * 5_000, None, ""]
    rows = [(r.randint(0, 400), t) for t in texts] + [(None, "no id"), (None, "no id"), (None, None), (-5, "below")]
    return rows


def test_checksums():
    assert recordfiles.crc32c([b"123456789", b"", b"a"]).tolist() == [0xE3069283, 0, 0xC1D04330]
    table, data = recordfiles._byte_table().tolist(), random.Random(1).randbytes(3000)

    def plain(x):
        c = 0xFFFFFFFF
        for v in x:
            c = table[(c ^ v) & 255] ^ c >> 8
        return c ^ 0xFFFFFFFF

    cuts = (0, 1, 2, 511, 512, 513, 1024, 3000)
    assert recordfiles.crc32c([data[:n] for n in cuts]).tolist() == [plain(data[:n]) for n in cuts]
    # The known frame of an empty record of this format: length 0, its masked checksum, no data, its masked checksum.
    assert recordfiles.frames([b""])[0][:8] == bytes(8) and struct.unpack("<I", recordfiles.frames([b""])[0][12:]) == (0xA282EAD8,)


def test_ids_are_the_library_s(monkeypatch):
    encoder = recordfiles.Encoder(VOCABULARY)
    texts = [t or "" for _, t in documents()] + [f"a{chr(c)}b {chr(c)}{chr(c)}'s{chr(c)}" for c in range(0x250)]
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    for chunk, known in ((8 << 20, 1 << 20), (40, 7)):
        monkeypatch.setattr(recordfiles, "CHUNK", chunk)
        monkeypatch.setattr(recordfiles, "MAX_KNOWN", known)
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_records_round_trip(spark, tmp_path):
    rows = documents()
    library = recordfiles.Encoder(VOCABULARY).library
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, path string, record int").repartition(3)
    where = f"file://{tmp_path}"
    files = recordfiles.write_records(df, where, VOCABULARY).cache()
    assert sorted(r.path for r in files.collect()) == sorted(r.path.removeprefix("file:") for r in recordfiles.record_files(spark, where).collect())
    ids = {t: library.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows}
    found = recordfiles.read_records(recordfiles.spans(files, 3000), seed=4, ids=True).collect()
    ordered = sorted(found, key=lambda r: (r.path, r.record))
    assert [r.doc_id for r in ordered] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == Counter((i, tuple(ids[t])) for i, t in rows)
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) for r in found)
    at = 0
    whole = recordfiles.record_round_trip(df, VOCABULARY).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found)
    for r in sorted(whole, key=lambda r: (r.start, r.n_tokens)):
        assert r.start == at
        at += r.n_tokens
    assert at == sum(len(ids[t]) for _, t in rows)


def test_wide_and_narrow_tokens():
    for ids in ([], [1], [65535], [65536, 2]):
        for doc_id in (None, 0, -7):
            data = recordfiles.serialized(doc_id, np.array(ids, "<u4"))
            assert recordfiles.parsed(data) == (doc_id, struct.pack(f"<{len(ids)}I", *ids)) and len(data) == 9 + len(ids) * (4 if max(ids, default=0) > 65535 else 2)


def test_damaged_records_are_found(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(10)], "doc_id long, text string").coalesce(1)
    recordfiles.write_records(df, f"file://{tmp_path}", VOCABULARY).collect()
    path = sorted(tmp_path.glob("*.rec"))[0]
    good = path.read_bytes()
    assert len(recordfiles.unframed(good, "x")) > 0
    for at in (0, 9, 13, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="x: "):
            recordfiles.unframed(bytes(bad), "x")
    with pytest.raises(ValueError, match="cut"):
        recordfiles.unframed(good[:-3], "x")


def test_no_documents_no_records(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert recordfiles.record_round_trip(df, VOCABULARY).collect() == []
