"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, oracle: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[name] = f
            if oracle:
                self.oracles[name] = oracle
            return f

        return add
