"""Detections of the user's own, by name.

A registered detection is a category like the five built-in ones: it shows in
the findings, in the policies, in the counts and, by its signal, in the ATT&CK
references.  Functions take a registry where they can show added categories;
``DEFAULT`` is the one ``register_detection`` adds to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

#: Takes the edges and the devices, returns rows with columns of either.
Finder = Callable[[DataFrame, DataFrame], DataFrame]

BUILT_IN = ("cross_zone_violations", "new_devices", "new_edges", "interval_deviation", "unknown_protocol")


class Detection(NamedTuple):
    """``policy`` is the set-valued form; without it the different rows of ``find``."""

    name: str
    find: Finder
    signal: str
    policy: Finder | None = None

    def violations(self, edges: DataFrame, devices: DataFrame) -> DataFrame:
        return self.policy(edges, devices) if self.policy else self.find(edges, devices).distinct()


class Registry:
    """Added detections in the order they were registered."""

    def __init__(self) -> None:
        self._known: dict[str, Detection] = {}

    def register(self, name: str, find: Finder, signal: str | None = None, policy: Finder | None = None) -> Detection:
        """Add a detection; a name that is taken already is an error.

        ``signal`` ties it to techniques; without one it is the name itself.
        """
        if name in BUILT_IN or name in self._known:
            raise ValueError(f"a detection {name!r} exists already")
        self._known[name] = Detection(name, find, signal or name, policy)
        return self._known[name]

    def remove(self, name: str) -> None:
        del self._known[name]

    def __iter__(self) -> Iterator[Detection]:
        return iter(self._known.values())

    @property
    def categories(self) -> list[str]:
        return [*BUILT_IN, *self._known]

    @property
    def signals(self) -> dict[str, str]:
        return {d.name: d.signal for d in self}


DEFAULT = Registry()


def register_detection(name: str, find: Finder, signal: str | None = None, policy: Finder | None = None) -> Detection:
    """Add a detection to those that all functions show by default."""
    return DEFAULT.register(name, find, signal, policy)
