"""Driver loops: each round is one written table, so lineage stays short and lost executors cost one round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from skein.plans.scratch import remove, scratch_path


class Rounds:
    """Tables written round after round under one folder; ``all`` reads every round's rows."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.schema, self.path, self.n = df.sparkSession, df.schema, scratch_path(df.sparkSession, name), 0

    def add(self, df: DataFrame) -> DataFrame:
        """Writes a round and reads it back."""
        path = f"{self.path}/round={self.n}"
        df.write.parquet(path)
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/round={k}" for k in range(self.n)))

    def forget(self, k: int) -> None:
        """Deletes a round that no later plan reads."""
        remove(self.spark, f"{self.path}/round={k}")


def until(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, DataFrame, int], bool], name: str, most: int) -> tuple[DataFrame, int]:
    """``step`` applied to its own written result until ``done(before, after, round)`` or ``most`` rounds; the last table and the rounds taken."""
    rounds = Rounds(start, name)
    state = rounds.add(start)
    for k in range(1, most + 1):
        new = rounds.add(step(state, k))
        over = done(state, new, k)
        if k >= 1:
            rounds.forget(k - 1)
        state = new
        if over:
            return state, k
    return state, most
