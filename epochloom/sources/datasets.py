"""Named dataset sources: a registry that fails closed."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Source = Callable[[SparkSession], tuple[DataFrame, DataFrame]]


@dataclass
class Registry:
    """Factories ``spark -> (rows, lineage)`` by dataset name."""

    sources: dict[str, Source] = field(default_factory=dict)
    absent: set[str] = field(default_factory=set)

    def register(self, name: str, source: Source) -> None:
        if name in self.sources:
            raise ValueError(f"dataset {name} is registered already")
        self.sources[name] = source

    def declare_absent(self, name: str) -> None:
        """A known dataset without verified data; resolving it is refused."""
        self.absent.add(name)

    def resolve(self, name: str, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        if name in self.absent:
            raise FileNotFoundError(f"dataset {name} is not present; refusing to infer a format")
        if name not in self.sources:
            raise ValueError(f"Unknown dataset {name}")
        return self.sources[name](spark)
