"""Options of the encoders: typed, with bounds, and what each means to the codec."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


class OptionError(ValueError):
    """An option that a format doesn't have, has twice, or has no such value of."""


@dataclass(frozen=True)
class Option:
    """kind: integer (low to high), boolean or choice (a name and what it stands for). needs: (option, value) without
    which this one has no effect."""

    name: str
    kind: str
    default: str
    low: int = 0
    high: int = 0
    choices: tuple[tuple[str, object], ...] = ()
    needs: tuple[str, str] | None = None
    argument: str = ""

    def parse(self, text: str) -> object:
        if self.kind == "integer":
            if not text.strip().removeprefix("-").isdigit() or not self.low <= int(text) <= self.high:
                raise OptionError(f"{self.name} takes an integer from {self.low} to {self.high}, not {text!r}")
            return int(text)
        known = {"true": True, "false": False} if self.kind == "boolean" else {k.lower(): v for k, v in self.choices}
        if text.lower() not in known:
            raise OptionError(f"{self.name} takes one of {', '.join(known)}, not {text!r}")
        return known[text.lower()]


_FILTERS = (("adaptive", None), ("none", 0), ("sub", 1), ("up", 2), ("average", 3), ("paeth", 4))
OPTIONS: dict[str, tuple[Option, ...]] = {
    "png": (
        Option("compression", "choice", "smallest", choices=tuple((k, k) for k in ("none", "fast", "optimal", "smallest")), argument="effort"),
        Option("filter", "choice", "adaptive", choices=_FILTERS, argument="row_filter"),
    ),
    "jpeg": (
        Option("quality", "integer", "90", 1, 100, argument="quality"),
        Option("chroma-subsampling", "choice", "420", choices=tuple((k, k) for k in ("444", "422", "420")), argument="subsampling"),
        Option("progressive", "boolean", "false", argument="progressive"),
        Option("restart-interval", "integer", "0", 0, 65535, needs=("progressive", "false"), argument="restart"),
    ),
    "webp": (
        Option("lossless", "boolean", "true", argument="lossless"),
        Option("quality", "integer", "75", 0, 100, needs=("lossless", "false"), argument="quality"),
        Option("effort", "choice", "balanced", choices=tuple((k, k) for k in ("fast", "balanced", "best")), argument="effort"),
    ),
    "exr": (Option("compression", "choice", "zip", choices=tuple((k, k) for k in ("none", "rle", "zips", "zip", "piz")), argument="compression"),),
    "ktx2": (Option("compression", "choice", "none", choices=(("none", False), ("zlib", True)), argument="compress"),),
    "dds": (),
    "hdr": (),
}


def parse(fmt: str, pairs: Iterable[tuple[str, str]]) -> dict[str, object]:
    """Encoder arguments from (name, value) pairs; names and values regardless of case, each name once."""
    known, out, given = {o.name: o for o in OPTIONS[fmt]}, {}, {}
    for name, value in pairs:
        option = known.get(name.lower())
        if option is None:
            raise OptionError(f"{fmt} has no option {name}; it has {', '.join(known) or 'none'}")
        if option.name in given:
            raise OptionError(f"{name} is given twice")
        given[option.name] = value.lower()
        out[option.argument] = option.parse(value)
    for name in given:
        needs = known[name].needs
        if needs and given.get(needs[0], known[needs[0]].default) != needs[1]:
            raise OptionError(f"{name} needs {needs[0]}={needs[1]}")
    return out
