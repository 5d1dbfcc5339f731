"""Document processing as an ordered list of DataFrame functions, and its settings."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions import text as T
from sheetloom.operators import patterns as P
from sheetloom.plans.errors import ERRORS, handled, routed

Stage = Callable[[DataFrame], DataFrame]


#: Environment variable -> setting.
ENVIRONMENT = {
    "OCR_PREFERRED_ENGINE": "ocr.preferred_engine",
    "AWS_ACCESS_KEY_ID": "ocr.aws_access_key_id",
    "AWS_SECRET_ACCESS_KEY": "ocr.aws_secret_access_key",
    "AWS_SESSION_TOKEN": "ocr.aws_session_token",
    "AWS_DEFAULT_REGION": "ocr.aws_region",
    "TESSERACT_CMD": "ocr.tesseract_cmd",
    "AZURE_DOCUMENT_ENDPOINT": "ocr.azure_endpoint",
    "AZURE_DOCUMENT_KEY": "ocr.azure_api_key",
    "PDF_PROCESSOR_LOG_LEVEL": "logging.level",
    "REDIS_HOST": "cache.redis_host",
    "REDIS_PORT": "cache.redis_port",
}


@dataclass
class Config:
    """Settings by section; values come from the defaults, then the environment, then a file, then ./config.json."""

    ocr: dict[str, Any] = field(default_factory=lambda: {"preferred_engine": "tesseract", "confidence_threshold": 0.5, "max_retries": 3, "timeout_seconds": 30})
    processing: dict[str, Any] = field(default_factory=lambda: {"use_ocr": True, "extract_tables": True, "extract_patterns": True, "enhance_images": True})
    evaluation: dict[str, Any] = field(default_factory=lambda: {"iou_thresholds": [0.5, 0.75]})
    output: dict[str, Any] = field(default_factory=lambda: {"formats": ["json", "csv", "structured_table"], "default_format": "json"})
    logging: dict[str, Any] = field(default_factory=lambda: {"level": "INFO", "file_path": None})
    cache: dict[str, Any] = field(default_factory=dict)
    performance: dict[str, Any] = field(default_factory=dict)
    security: dict[str, Any] = field(default_factory=lambda: {"allowed_extensions": [".pdf"], "max_file_size_mb": 100})

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        config = cls()
        for name, setting in ENVIRONMENT.items():
            if value := os.environ.get(name):
                config.set(setting, int(value) if setting.endswith("_port") else value)
        for each in (path, "config.json"):
            if each and os.path.exists(each):
                config.merge(each)
        return config

    def merge(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            for section, values in json.load(file).items():
                if section in {f.name for f in fields(self)}:
                    getattr(self, section).update(values)

    def get(self, path: str, default: Any = None) -> Any:
        section, _, key = path.partition(".")
        values = getattr(self, section, {})
        return values.get(key, default) if key else values

    def set(self, path: str, value: Any) -> None:
        section, _, key = path.partition(".")
        getattr(self, section)[key] = value

    def problems(self) -> list[str]:
        found = []
        if not self.ocr.get("preferred_engine"):
            found.append("no preferred engine")
        if not 0 <= self.ocr.get("confidence_threshold", 0) <= 1:
            found.append("confidence threshold outside 0 to 1")
        if any(not 0 <= t <= 1 for t in self.evaluation.get("iou_thresholds", [])):
            found.append("IoU threshold outside 0 to 1")
        if self.ocr.get("preferred_engine") == "aws_textract" and not (self.ocr.get("aws_access_key_id") and self.ocr.get("aws_secret_access_key")):
            found.append("no keys for the preferred engine")
        if (log := self.logging.get("file_path")) and not os.path.isdir(os.path.dirname(os.path.abspath(log))):
            found.append("no folder for the log file")
        if self.output.get("default_format", "json") not in self.output.get("formats", []):
            found.append("default format is not supported")
        return found

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as file:
            json.dump(asdict(self), file, indent=2)


class Pipeline:
    """Named stages in order; one that a flag switches off is left out of the plan."""

    def __init__(self, stages: list[tuple[str, Stage]] | None = None):
        self.stages = list(stages if stages is not None else DEFAULT)

    def add(self, name: str, stage: Stage, position: int | None = None) -> None:
        self.stages.insert(len(self.stages) if position is None else position, (name, stage))

    def remove(self, name: str) -> bool:
        kept = [s for s in self.stages if s[0] != name]
        changed, self.stages = len(kept) < len(self.stages), kept
        return changed

    def info(self) -> list[dict[str, Any]]:
        return [{"name": name, "position": k} for k, (name, _) in enumerate(self.stages)]

    def run(self, docs: DataFrame, off: tuple[str, ...] = ()) -> DataFrame:
        for name, stage in self.stages:
            if name not in off:
                docs = docs.transform(stage)
        return docs

    def run_checked(self, docs: DataFrame, needs: dict[str, tuple[str, ...]] | None = None, rules: dict[str, list[tuple[Column, str, str]]] | None = None, off: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
        """(documents, errors, skipped stages). A stage that needs columns which are not there is skipped; rows that the rules
        of a stage refuse go to the errors (doc_id, stage, error_class, message) before it."""
        errors, skipped = docs.sparkSession.createDataFrame([], ERRORS), []
        for name, stage in self.stages:
            if name in off:
                continue
            if not set((needs or {}).get(name, ())) <= set(docs.columns):
                skipped.append(name)
                continue
            if own := (rules or {}).get(name):
                docs, bad = routed(docs, name, own)
                errors = errors.unionByName(bad)
            docs = docs.transform(handled(name, stage))
        return docs, errors, skipped


def structure(docs: DataFrame) -> DataFrame:
    return docs.withColumns(T.structure(F.col("text")))


def classify(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"document_type": T.document_type(F.col("text")), "document_characteristics": T.characteristics(F.col("text"))})


def extract(docs: DataFrame) -> DataFrame:
    """With structured_data: key -> values of all matches, of what the type adds and of the structure; null for blank texts."""
    entries = F.array_sort(F.collect_list(F.struct("key", "values")))
    found = P.structured(docs).groupBy("doc_id").agg(F.map_from_entries(entries).alias("structured_data"))
    return docs.join(found, "doc_id", "left")


def finalize(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", T.strip(F.col("text")))


DEFAULT: list[tuple[str, Stage]] = [("structure", structure), ("extract_patterns", extract), ("classification", classify), ("finalization", finalize)]
