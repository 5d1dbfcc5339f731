"""Recognition engines: what a plug-in has to offer, a registry that falls back by priority, retries.

An engine turns the bytes of a page's image into elements. It runs inside the tasks, one page after another, so engines
have to be picklable; the registry is plain driver-side code.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ELEMENTS = "doc_id long, page_number int, ord long, text string, confidence double, x double, y double, w double, h double, engine string, error string"


class Engine(Protocol):
    name: str
    priority: int
    confidence_threshold: float
    timeout: float
    max_retries: int

    def available(self) -> tuple[bool, str]:
        """Whether it can be used here, and why not."""

    def read(self, image: bytes, page_number: int) -> list[dict[str, Any]]:
        """Elements: text, confidence, x, y, w, h."""


def attempt(engine: Engine, image: bytes, page_number: int, pause: float = 0.5) -> list[dict[str, Any]]:
    """The engine's sure elements. It is asked once more after every failure or late answer, ``max_retries`` times, after longer and longer pauses."""
    for k in range(engine.max_retries + 1):
        try:
            began = time.monotonic()
            found = engine.read(image, page_number)
            if time.monotonic() - began > engine.timeout:
                raise TimeoutError(f"{engine.name} took more than {engine.timeout} s")
            return [e for e in found if e["confidence"] >= engine.confidence_threshold]
        except Exception as error:
            if k == engine.max_retries:
                raise RuntimeError(f"{engine.name}, page {page_number}: {error}") from error
            time.sleep(pause * (k + 1))
    return []


class Registry:
    """Engines by name, in order of priority."""

    def __init__(self, engines: Iterable[Engine] = ()):
        self.engines: dict[str, Engine] = {}
        for engine in engines:
            self.register(engine)

    def register(self, engine: Engine) -> None:
        self.engines[engine.name] = engine

    def unregister(self, name: str) -> bool:
        return self.engines.pop(name, None) is not None

    def get(self, name: str) -> Engine | None:
        return self.engines.get(name)

    @staticmethod
    def state(engine: Engine) -> tuple[bool, str]:
        try:
            return engine.available()
        except Exception as error:
            return False, str(error)

    def available(self) -> list[Engine]:
        in_order = sorted(self.engines.values(), key=lambda e: e.priority)
        return [e for e in in_order if self.state(e)[0]]

    def best(self, preferred: str | None = None) -> Engine | None:
        """The preferred one if it can be used, else the first that can."""
        usable = self.available()
        return next((e for e in usable if e.name == preferred), usable[0] if usable else None)

    def info(self, spark: SparkSession) -> DataFrame:
        rows = [(e.name, e.priority, self.state(e)[0], float(e.confidence_threshold), float(e.timeout)) for e in self.engines.values()]
        return spark.createDataFrame(rows, "name string, priority int, available boolean, confidence_threshold double, timeout double")

    def problems(self) -> dict[str, list[str]]:
        states = {name: self.state(e) for name, e in self.engines.items()}
        return {name: [f"not available: {why}"] for name, (usable, why) in states.items() if not usable}

    def read(self, pages: DataFrame, pause: float = 0.5) -> DataFrame:
        """Elements of pages (doc_id, page_number, image) by the first engine that finds any; a page that none can read is one row with an error."""
        usable = self.available()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for doc, page, image in zip(batch["doc_id"], batch["page_number"], batch["image"]):
                    last, found = "no engine is available", []
                    for engine in usable:
                        try:
                            found = attempt(engine, bytes(image), int(page), pause)
                            last = f"{engine.name} found nothing"
                        except Exception as error:
                            last = str(error)
                        if found:
                            rows += [(doc, page, k, e["text"].strip(), e["confidence"], e.get("x"), e.get("y"), e.get("w"), e.get("h"), engine.name, None) for k, e in enumerate(found)]
                            break
                    if not found:
                        rows.append((doc, page, None, None, None, None, None, None, None, None, last))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ELEMENTS.split(", ")])

        return pages.select("doc_id", "page_number", "image").mapInPandas(run, ELEMENTS)
