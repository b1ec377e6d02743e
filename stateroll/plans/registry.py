"""Custom processor kinds: a reduction is a pair of functions, rows to states and states to coarser states."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame


class Kind(NamedTuple):
    build: Callable[[DataFrame, list[str]], DataFrame]
    merge: Callable[[DataFrame, list[str]], DataFrame]


_KINDS: dict[str, Kind] = {}


def register(name: str, build: Callable, merge: Callable) -> None:
    if name in _KINDS:
        raise ValueError(f"a kind named {name!r} is registered already")
    _KINDS[name] = Kind(build, merge)


def unregister(name: str) -> None:
    _KINDS.pop(name, None)


def kind(name: str) -> Kind:
    if name not in _KINDS:
        raise KeyError(f"no kind named {name!r}; registered: {', '.join(sorted(_KINDS)) or 'none'}")
    return _KINDS[name]
