"""Names of variables: at most 32 letters, digits and underscores."""

from __future__ import annotations

import re

from ..errors import VerbError

#: Words that are no names.
RESERVED = frozenset("_all _b byte _coef _cons double float if in int long _n _N _pi _pred _rc _skip strL using with".split())
LONGEST = 32


def is_name(name: str) -> bool:
    return bool(re.fullmatch(r"[^\W\d]\w*", name)) and len(name) <= LONGEST and name not in RESERVED and not re.fullmatch(r"str\d+", name)


def valid_name(name: str) -> str:
    if not is_name(name) or name.startswith("__"):
        raise VerbError(f"{name!r} is not a valid name")
    return name


def sanitised(names: list[str]) -> list[str]:
    """Valid, different names for any column names."""
    out: list[str] = []
    for raw in names:
        name = re.sub(r"\W", "_", raw) or "_"
        if name[0].isdigit():
            name = "_" + name
        name = name[:LONGEST]
        if not is_name(name):
            name = ("_" + name)[:LONGEST]
        final, k = name, 2
        while final in out:
            tail = f"_{k}"
            final, k = name[: LONGEST - len(tail)] + tail, k + 1
        out.append(final)
    return out
