"""python -m imagelake INPUT... FOLDER --to FORMAT [options]: converts image files, or folders of them, by a Spark job.

--crop x,y,w,h  --resize WxH  --target-size 10K  --policy strict|preserve|preview|explicit  --encoding NAME
--metadata keep|drop (dropped if not given)
--option name=value (as often as needed)  --formats: lists formats and their options
--webp-tables PATH: the text of RFC 6386, whose tables lossy WebP needs"""

from __future__ import annotations

import argparse
import re
import sys

from imagelake.plans.convert import Request, convert_folder
from imagelake.plans.planner import POLICIES
from imagelake.sources.base import FormatError
from imagelake.sources.catalog import REGISTRY
from imagelake.sources.options import OPTIONS, OptionError


def numbers(text: str, form: str, divider: str) -> tuple[int, ...]:
    parts = text.lower().split(divider)
    if len(parts) != form.count(divider) + 1 or not all(re.fullmatch(r"-?\d+", p) for p in parts):
        raise OptionError(f"{text!r} is not of the form {form}")
    return tuple(map(int, parts))


def size(text: str) -> int:
    m = re.fullmatch(r"(\d+)([KMG]?)B?", text.upper())
    if not m:
        raise OptionError(f"{text!r} is no size")
    return int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2]]


def listing() -> str:
    lines = []
    for name, codec in REGISTRY.codecs.items():
        lines.append(f"{name} ({', '.join(codec.extensions)})")
        for o in OPTIONS[name]:
            allowed = f"{o.low} to {o.high}" if o.kind == "integer" else "true, false" if o.kind == "boolean" else ", ".join(k for k, _ in o.choices)
            lines.append(f"  {o.name}: {allowed}; {o.default} if not given" + (f"; with {o.needs[0]}={o.needs[1]}" if o.needs else ""))
    return "\n".join(lines)


def request_of(args: argparse.Namespace) -> Request:
    pairs = []
    for text in args.option or ():
        name, is_, value = text.partition("=")
        if not is_:
            raise OptionError(f"{text!r} is not of the form name=value")
        pairs.append((name, value))
    tables = None
    if args.webp_tables:
        from imagelake.sources.files import read_bytes
        from imagelake.sources.vp8 import tables_of

        tables = tables_of(read_bytes(args.webp_tables).decode("utf-8", "replace"))
    made = Request(
        args.to, numbers(args.crop, "x,y,w,h", ",") if args.crop else None, numbers(args.resize, "wxh", "x") if args.resize else None, args.policy, args.encoding, tuple(pairs),
        size(args.target_size) if args.target_size else None, tables, args.metadata,
    )
    made.check()
    return made


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="imagelake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("places", nargs="*")
    for name in ("to", "crop", "resize", "target-size", "encoding", "webp-tables"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--policy", choices=POLICIES, default="preview")
    parser.add_argument("--metadata", choices=("drop", "keep"), default="drop")
    parser.add_argument("--option", action="append")
    parser.add_argument("--formats", action="store_true")
    args = parser.parse_args(argv)
    if args.formats:
        print(listing())
        return 0
    if len(args.places) < 2 or not args.to:
        parser.print_usage(sys.stderr)
        return 2
    try:
        request = request_of(args)
    except (OptionError, FormatError) as e:
        print(e, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("imagelake").getOrCreate()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(args.places[:-1]).select("path", "content")
    failed = 0
    try:
        written = convert_folder(files, request, args.places[-1])
    except FileExistsError as e:
        print(e, file=sys.stderr)
        return 2
    for r in written.toLocalIterator():
        failed += r.error is not None
        print(f"{r.path}: {r.error or f'{r.place}, {r.bytes} bytes'}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
