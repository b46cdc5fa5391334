"""The set of ledger tables a report reads."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame


class Books:
    """Named DataFrames, reached as attributes (``books.sales``).

    A value may also be a zero-argument callable; it runs on first use, so a
    report only plans the tables it reads.
    """

    def __init__(self, frames: Mapping[str, DataFrame | Callable[[], DataFrame]] | None = None, **more):
        self._frames = {**(frames or {}), **more}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            frame = self._frames[name]
        except KeyError:
            raise AttributeError(f"no table {name!r} in these books") from None
        if not isinstance(frame, DataFrame) and callable(frame):
            frame = self._frames[name] = frame()
        return frame

    def define(self, name: str, frame: DataFrame | Callable[[], DataFrame]) -> None:
        self._frames[name] = frame

    def __contains__(self, name: str) -> bool:
        return name in self._frames

    def tables(self) -> list[str]:
        return list(self._frames)

    def replace(self, **more) -> Books:
        """A copy with some tables swapped."""
        return Books(self._frames, **more)
