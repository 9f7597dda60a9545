"""Metadata kept by conversions: each writer's entries, terms between formats, and typed losses."""

import numpy as np
import pytest

from imagelake.plans.convert import Request, convert_files, converted
from imagelake.plans.planner import Capabilities, Description, PlanError, plan
from imagelake.sources.base import Image
from imagelake.sources.catalog import REGISTRY
from imagelake.sources.metadata import exr_value, file_metadata, translated

WHITE = [0.3127, 0.329, 0.64, 0.33, 0.3, 0.6, 0.15, 0.06]
TEXTS = [("png.text", "Title", "A café"), ("png.text", "Author", "Ω 漢"), ("png.text", "Creation Time", "2024"), ("png.text", "Comment", "two\nlines"), ("png.text", "Lens", "50 mm"), ("png", "chromaticities", WHITE)]


def file(fmt: str, metadata: list, sample: str = "unorm8", channels: str = "RGB") -> bytes:
    v = np.arange(9 * 10 * len(channels)).reshape(9, 10, len(channels)) % 200
    kind = {"unorm8": np.uint8, "float32": np.float32}[sample]
    return REGISTRY.codecs[fmt].encode(Image(fmt, list(channels), sample, (v / 200 if sample == "float32" else v).astype(kind), metadata=metadata))


def held(data: bytes) -> list:
    return REGISTRY.resolve(data[:16]).decode(data).metadata


@pytest.mark.parametrize(
    "fmt, sample, entries",
    [
        ("png", "unorm8", [*TEXTS, ("png", "gamma", 0.45455), ("png", "sRGB", 1), ("png", "icc:profile", b"abc" * 50), ("png.text", "Title", "again")]),
        ("exr", "float32", [("exr", "owner", "me"), ("exr", "n" * 40, "long name"), ("exr", "frames", 24), ("exr", "utcOffset", 1.5), ("exr", "chromaticities", [0.5] * 8), ("exr", "odd", ("v2i", bytes(8)))]),
        ("ktx2", "unorm8", [("ktx2", "KTXwriter", b"me\0"), ("ktx2", "raw", b"\1\2\3")]),
        ("hdr", "float32", [("hdr", "SOFTWARE", "me"), ("hdr", "VIEW", "-vp 0 0 0")]),
    ],
)
def test_writers_emit_what_readers_find(fmt, sample, entries):
    data = file(fmt, entries, sample, "RGBA" if fmt == "ktx2" else "RGB")
    assert sorted(map(repr, held(data))) == sorted(map(repr, entries))
    again = converted(data, Request(fmt, policy="preview" if fmt == "hdr" else "strict", metadata="keep"))  # HDR is packed, a loss of its own
    assert sorted(map(repr, held(again.content))) == sorted(map(repr, entries)) and not [x for x in again.plan.losses if x.category == "metadata"]
    assert held(converted(data, Request(fmt)).content) == []  # dropped if nothing else is said


def test_jpeg_comments():
    data = file("jpeg", [("jpeg", "comment", "é".encode()), ("jpeg", "comment", b"\xff")])
    assert [e for e in held(data) if e[1] == "comment"] == [("jpeg", "comment", "é".encode()), ("jpeg", "comment", b"\xff")]
    out = converted(data, Request("png", metadata="keep"))
    assert held(out.content) == [("png.text", "Comment", "é"), ("png.text", "Comment", "ÿ")]
    back, losses = translated([*TEXTS, ("png.text", "Comment", "x" * 70_000)], "jpeg")
    assert back == [("jpeg", "comment", b"two\nlines")] and len(losses) == 7  # six without a place, one renamed


@pytest.mark.parametrize("way", [("exr",), ("ktx2",), ("exr", "ktx2"), ("ktx2", "exr")])
def test_texts_come_back(way):
    data = file("png", TEXTS)
    for fmt in (*way, "png"):
        made = converted(data, Request(fmt, metadata="keep"))
        data = made.content
        assert [s.name for s in made.plan.steps if s.name.endswith("metadata")]
    want = TEXTS if way == ("exr",) else TEXTS[:-1]  # KTX2 has no chromaticities
    assert sorted(map(repr, held(data))) == sorted(map(repr, want))


def test_names_in_formats():
    exr, losses = translated(TEXTS, "exr")
    assert {e[1]: e[2] for e in exr} == {"Title": "A café", "Author": "Ω 漢", "capDate": "2024", "comments": "two\nlines", "Lens": "50 mm", "chromaticities": [float(np.float32(v)) for v in WHITE[2:] + WHITE[:2]]}
    assert all(not x.semantic for x in losses) and {x.message for x in losses} == {"png.text Creation Time: renamed to capDate", "png.text Comment: renamed to comments"}
    hdr, losses = translated([*TEXTS, ("png.text", "Software", "s")], "hdr")
    assert hdr == [("hdr", "Title", "A café"), ("hdr", "Creation Time", "2024"), ("hdr", "Lens", "50 mm"), ("hdr", "PRIMARIES", "0.64 0.33 0.3 0.6 0.15 0.06 0.3127 0.329"), ("hdr", "SOFTWARE", "s")]
    assert sorted(x.message for x in losses if x.semantic) == ["png.text Author: dropped, characters", "png.text Comment: dropped, no single line"]
    assert translated(hdr, "png")[0][3] == ("png", "chromaticities", WHITE)


def test_losses_are_typed():
    lost = lambda entries, fmt: [(x.message.split(": ")[1], x.semantic) for x in translated(entries, fmt)[1]]
    assert lost([("exr", "frames", 24)], "png") == [("retyped", False)]
    assert lost([("exr", "odd", ("v2i", bytes(8)))], "png") == [("dropped, no counterpart", True)]
    assert lost([("exr", "chromaticities", [1 / 3] * 8)], "png") == [("rounded", True)]
    assert lost([("exr", "chromaticities", [-0.1] * 8)], "png") == [("dropped, out of range", True)]
    assert lost([("hdr", "PRIMARIES", "a b")], "png") == [("dropped, no counterpart", True)]
    assert lost([("exr", " bad  key", "v")], "png") == [("dropped, no keyword", True)]
    assert lost([("exr", "a", "x\0y")], "ktx2") == [("dropped, a zero character", True)]
    assert lost([("png.text", "KTXorientation", "rd")], "ktx2") == [("dropped, a reserved name", True)]
    assert lost([("png.text", "owner", "v")], "exr") == [("dropped, a name with another meaning", True)]
    assert lost([("png.text", "Lens", "1"), ("png.text", "Lens", "2")], "exr") == [("dropped, Lens is taken", True)]
    assert lost([("png", "tRNS", b"\0")], "png") == [("dropped, it describes stored pixels", True)]
    assert lost([("png.text", "Lens", "1")], "dds") == [("dropped, the format's writer has no metadata", True)]
    assert lost([("jpeg", "app0", b"JFIF")], "png") == []
    assert exr_value("float", b"\0") == ("float", b"\0") and exr_value("int", b"\1\0\0\0") == 1


def test_plans_name_the_steps():
    steps = lambda to, spaces, keep="keep": [str(s) for s in plan(Description(4, 4, ("R", "G", "B"), metadata=spaces), Capabilities.of(REGISTRY.codecs[to]), "preview", metadata=keep).steps if "metadata" in s.name]
    assert steps("png", ("png.text", "png")) == ["preserve_metadata(png)", "preserve_metadata(png.text)"]
    assert steps("exr", ("png.text", "webp")) == ["translate_metadata(png.text, exr)", "drop_metadata(webp)"]
    assert steps("dds", ("png.text",)) == ["drop_metadata(png.text)"] == steps("exr", ("png.text",), "drop")
    with pytest.raises(PlanError):
        steps("png", (), "guess")


def test_policies_see_each_entry():
    data = file("png", [("png.text", "Comment", "c")])
    assert held(converted(data, Request("exr", policy="preview", metadata="keep")).content) == [("exr", "comments", "c")]
    bad = file("exr", [("exr", "odd", ("v2i", bytes(8)))], "float32")
    with pytest.raises(PlanError) as e:
        converted(bad, Request("ktx2", policy="preserve", metadata="keep"))
    assert e.value.category == "metadata"
    assert held(converted(bad, Request("ktx2", metadata="keep")).content) == []


def test_rows_of_files(spark):
    rows = [(1, file("png", TEXTS)), (2, None), (3, b"\x89PNG broken"), (4, file("ktx2", [("ktx2", "raw", b"\1\2"), ("ktx2", "KTXwriter", b"me\0")], channels="RGBA"))]
    files = spark.createDataFrame(rows, "path int, content binary")
    found = {(r.path, r.namespace, r.key): r.value for r in file_metadata(files).collect()}
    assert found[1, "png.text", "Author"] == "Ω 漢" and found[1, "png", "chromaticities"].startswith("0.3127 0.329 0.64")
    assert found[4, "ktx2", "raw"] == "0102" and found[4, "ktx2", "KTXwriter"] == "me" and {k[0] for k in found} == {1, 4}
    made = {r.path: r for r in convert_files(files, Request("exr", metadata="keep")).collect()}
    assert "translate_metadata(png.text, exr)" in made[1].steps and made[1].losses.count("metadata") == 2 and made[2].error and made[3].error


def test_texts_of_image_rows(spark):
    from imagelake.sources.catalog import IMAGE_SCHEMA, encode_images

    row = lambda k, texts: (k, "png", 1, 1, ["R", "G", "B"], "unorm8", None, "identity", [1.0, 2.0, 3.0], None, texts)
    rows = [row(1, {"Title": "a", "Author": None}), row(2, None), row(3, {}), row(4, {"x\0": "b"})]
    images = spark.createDataFrame(rows, f"path int, {IMAGE_SCHEMA}, texts map<string, string>")
    for fmt, name in (("png", "png.text"), ("jpeg", None)):
        made = {r.path: r for r in encode_images(images, fmt, texts="texts").collect()}
        if name:
            assert [held(made[k].content) for k in (1, 2, 3)] == [[(name, "Title", "a")], [], []] and "no keyword" in made[4].error
        else:
            assert made[1].content is None and "no counterpart" in made[1].error and made[2].content


def test_rows_of_one_file_are_dealt_out_by_their_number(spark, monkeypatch):
    from imagelake import query_base
    from imagelake.queries import QUERIES

    monkeypatch.setattr(query_base, "ROWS_PER_TASK", 10)
    made = QUERIES["metadata_translated"](spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() == -(-spark.read.parquet("/root/testdata/sf0.001/part.parquet").count() // 10)


def test_chain_makes_each_file_of_the_one_before(spark, monkeypatch):
    from imagelake.plans import convert
    from imagelake.sources import png

    image = Image("png", list("RGB"), "unorm8", np.arange(48, dtype=np.uint8).reshape(4, 4, 3), metadata=[("png.text", "Comment", "a b")])
    files = spark.createDataFrame([(k, bytearray(png.encode(image)) if k else bytearray(b"?")) for k in range(5)], "k int, content binary").coalesce(1)
    requests = [convert.Request(to, metadata="keep") for to in ("exr", "ktx2", "png")]
    want, rest = {}, files
    for step, r in enumerate(requests):
        rest = convert.convert_files(rest.select("k", "content"), r, ("k",))
        want |= {(x.k, step): x for x in rest.collect()}
    for size in (convert.HANDED_ON, 1):
        monkeypatch.setattr(convert, "HANDED_ON", size)
        made = convert.convert_chain(files, requests, ("k",)).collect()
        assert len(made) == len(want) == 15
        for r in made:
            assert (r.content, r.steps, r.losses, r.error) == (lambda w: (w.content, w.steps, w.losses, w.error))(want[r.k, r.step])
            assert (r.error is None) == (r.k > 0)
