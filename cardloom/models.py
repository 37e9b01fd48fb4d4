"""Models behind the operators: what a detector and a recogniser must do, and one copy of each in a worker."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np

#: (class, confidence, x1, y1, x2, y2)
Box = tuple[str | int, float, float, float, float, float]
#: (corners or outline, text, confidence)
Reading = tuple[np.ndarray, str, float]


class Detector(Protocol):
    def __call__(self, picture: np.ndarray) -> list[Box]:
        """The boxes in a blue-green-red picture, in the order of their report."""


class Recogniser(Protocol):
    def __call__(self, picture: np.ndarray) -> list[Reading]:
        """The pieces of text in a crop, flat or in pages and lines (see ``readings``)."""


def readings(raw: list | None) -> list[Reading]:
    """Pieces of text from either shape that recognisers report, those without text left out.

    Flat: (outline, text, confidence) each. Nested: pages of lines of (outline, (text, confidence)),
    where a page or a line may be None.
    """
    out: list[Reading] = []
    for entry in raw or []:
        if not entry:
            continue
        if len(entry) >= 3 and isinstance(entry[1], str):
            out.append((entry[0], entry[1], float(entry[2])))
            continue
        for line in entry:
            if line and len(line) > 1 and line[1] and len(line[1]) > 1 and line[1][0]:
                out.append((line[0], str(line[1][0]), float(line[1][1])))
    return [r for r in out if r[1]]


@dataclass(frozen=True)
class Models:
    """Functions that load the models; they travel to the workers, the models themselves don't.

    ``card`` finds cards (classes such as front-up), ``fields`` and ``regions`` the fields of an
    upright card (by name; by number), ``digits`` the digits of a number strip (class: its value).
    ``recognisers`` are tried in the order of the settings' engines; others are not used.
    """

    card: Callable[[], Detector] | None = None
    fields: Callable[[], Detector] | None = None
    regions: Callable[[], Detector] | None = None
    digits: Callable[[], Detector] | None = None
    recognisers: dict[str, Callable[[], Recogniser]] = field(default_factory=dict)

    def missing(self) -> list[str]:
        return [name for name in ("card", "fields", "regions", "digits") if getattr(self, name) is None]


_LOADED: dict[tuple[str, str, str], object] = {}
_LOCK = threading.Lock()


def loaded(name: str, load: Callable[[], object]) -> object:
    """What ``load`` gives, called once in a process for each name and function."""
    key = (name, getattr(load, "__module__", ""), getattr(load, "__qualname__", repr(load)))
    if key not in _LOADED:
        with _LOCK:
            if key not in _LOADED:
                _LOADED[key] = load()
    return _LOADED[key]
