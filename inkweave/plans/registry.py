"""Feature registry: features are functions that declare what they need, and are run once each, in order of need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Registry:
    def __init__(self) -> None:
        self._made: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}

    def feature(self, name: str, *needs: str) -> Callable:
        """Decorator: the function gets the needed DataFrames in the order they are named."""

        def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if name in self._made:
                raise ValueError(f"feature {name} is declared twice")
            self._made[name] = (needs, f)
            return f

        return add

    def order(self, wanted: list[str], given: set[str]) -> list[str]:
        """Features to make, needs first; unknown and circular needs are errors."""
        out: list[str] = []
        open_: list[str] = []

        def visit(n: str) -> None:
            if n in given or n in out:
                return
            if n not in self._made:
                raise KeyError(f"no feature {n}")
            if n in open_:
                raise ValueError("circular needs: " + " -> ".join([*open_, n]))
            open_.append(n)
            for m in self._made[n][0]:
                visit(m)
            open_.pop()
            out.append(n)

        for n in wanted:
            visit(n)
        return out

    def build(self, wanted: list[str], given: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The wanted features and all they need, as lazy DataFrames."""
        made = dict(given)
        for n in self.order(wanted, set(given)):
            needs, f = self._made[n]
            made[n] = f(*[made[m] for m in needs])
        return made
