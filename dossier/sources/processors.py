"""Readers of media by kind of file: the first that accepts a path processes it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from dossier.sources import files, tabular


@dataclass
class Processor:
    """accepts(path) says whether process(spark, path) reads it into (entities, edges, text), each a table or None."""

    name: str
    accepts: Callable[[str], bool]
    process: Callable[[SparkSession, str], dict[str, DataFrame | None]]


@dataclass
class Registry:
    processors: list[Processor] = field(default_factory=list)

    def register(self, processor: Processor, first: bool = False) -> None:
        """Adds a processor; first puts it before those that are there. One of the same name is replaced."""
        self.processors = [p for p in self.processors if p.name != processor.name]
        self.processors.insert(0 if first else len(self.processors), processor)

    def choose(self, path: str) -> Processor | None:
        return next((p for p in self.processors if p.accepts(path)), None)

    def process(self, spark: SparkSession, path: str) -> dict[str, DataFrame | None]:
        """What the first processor that accepts the path reads; nothing if there is none."""
        chosen = self.choose(path)
        return chosen.process(spark, path) if chosen else {"entities": None, "edges": None, "text": None}


def suffix(path: str) -> str:
    return PurePosixPath(path).suffix.lower()


def table_processor(specs: dict[str, tabular.Spec]) -> Processor:
    """Tables with a mapping give entities and edges; one without its mapping gives its rows as text only."""

    def process(spark: SparkSession, path: str) -> dict[str, DataFrame | None]:
        table, spec = files.read_table_file(spark, path), specs.get(PurePosixPath(path).stem)
        if spec is None:
            return {"entities": None, "edges": None, "text": table}
        out = tabular.ingest(table, spec, path)
        return {"entities": out["entities"], "edges": out["edges"], "text": None}

    return Processor("table", lambda p: suffix(p) in files.TABLES, process)


def text_processor() -> Processor:
    return Processor("text", lambda p: suffix(p) in files.TEXT, lambda spark, p: {"entities": None, "edges": None, "text": files.read_texts(spark, p)})


def standard(specs: dict[str, tabular.Spec] | None = None) -> Registry:
    return Registry([table_processor(specs or {}), text_processor()])
