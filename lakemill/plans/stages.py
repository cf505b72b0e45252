"""A runner of named stages: reaching a stage runs the ones before it that aren't done yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.tables import cut


class Stages:
    """Each stage maps a DataFrame to a DataFrame. Results are tables in the shared folder, so a later target starts from the last one."""

    def __init__(self, source: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]):
        self.source, self.stages = source, stages
        self.done: dict[str, DataFrame] = {}
        self.log: list[str] = []

    def reach(self, target: str, force: bool = False) -> DataFrame:
        """The target's result. force: it and all that follows it are computed anew."""
        names = [n for n, _ in self.stages]
        at = names.index(target)
        if force:
            for n in names[at:]:
                self.done.pop(n, None)
        df = self.source
        for name, run in self.stages[: at + 1]:
            if name not in self.done:
                self.done[name] = cut(run(df), name)
                self.log.append(name)
            df = self.done[name]
        return df
