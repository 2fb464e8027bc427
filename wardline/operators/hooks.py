"""Row hooks and named operations that a user registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Hook = Callable[[DataFrame], DataFrame]


class HookRegistry:
    """Functions from DataFrame to DataFrame that run when resources of a type are written, in registration order."""

    def __init__(self) -> None:
        self._hooks: dict[tuple[str, str], list[Hook]] = {}

    def on(self, resource_type: str, operation: str) -> Callable[[Hook], Hook]:
        def add(fn: Hook) -> Hook:
            self._hooks.setdefault((resource_type, operation), []).append(fn)
            return fn

        return add

    def on_create(self, resource_type: str) -> Callable[[Hook], Hook]:
        return self.on(resource_type, "create")

    def apply(self, df: DataFrame, resource_type: str, operation: str) -> DataFrame:
        for fn in self._hooks.get((resource_type, operation), []):
            df = df.transform(fn)
        return df


class OperationRegistry:
    """Named operations on DataFrames."""

    def __init__(self) -> None:
        self._operations: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, fn: Callable[..., DataFrame]) -> None:
        if name in self._operations:
            raise ValueError(f"{name} is registered already")
        self._operations[name] = fn

    def call(self, name: str, **frames) -> DataFrame:
        if name not in self._operations:
            raise KeyError(f"no operation {name}")
        return self._operations[name](**frames)

    def names(self) -> list[str]:
        return sorted(self._operations)
