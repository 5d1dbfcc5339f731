"""Errors as rows: which stage, of which class, about which document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: families of error classes
FAMILIES: dict[str, tuple[str, ...]] = {
    "FileError": ("FileNotFoundError", "UnsupportedFileTypeError", "FileCorruptedError", "FileSizeLimitError"),
    "OCRError": ("OCREngineNotAvailableError", "OCRExtractionError", "OCRConfigurationError", "OCRCredentialsError"),
    "ProcessingError": ("ExtractionError", "ImageProcessingError", "TableDetectionError", "PatternExtractionError", "SpatialAnalysisError"),
    "ValidationError": ("GroundTruthValidationError", "ConfigurationValidationError", "ResultValidationError"),
    "EvaluationError": ("MetricsCalculationError", "GroundTruthMismatchError"),
    "ExportError": ("UnsupportedExportFormatError", "ExportValidationError"),
    "ConfigurationError": ("MissingConfigurationError", "InvalidConfigurationError"),
    "DependencyError": ("MissingDependencyError", "DependencyVersionError"),
    "ResourceError": ("MemoryLimitError", "TimeoutError"),
    "CacheError": ("CacheConnectionError", "CacheKeyError"),
}
ERRORS = "doc_id string, stage string, error_class string, message string"


def family(error_class: str) -> str | None:
    """The family of an error class; a family is its own."""
    return next((name for name, leaves in FAMILIES.items() if error_class == name or error_class in leaves), None)


def family_of(error_class: Column) -> Column:
    pairs = [(leaf, name) for name, leaves in FAMILIES.items() for leaf in (name, *leaves)]
    return F.get(F.transform(F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]), lambda p: p["a"] == error_class), lambda p: p["b"]), F.lit(0))


def routed(docs: DataFrame, stage: str, rules: list[tuple[Column, str, str]], id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows that no rule refuses, errors): rules are (condition, error class, message); the first that holds counts."""
    for _, error_class, _ in rules:
        if family(error_class) is None:
            raise ValueError(f"no class of errors: {error_class}")
    why = F.lit(None).cast("struct<error_class: string, message: string>")
    for condition, error_class, message in reversed(rules):
        why = F.when(condition, F.struct(F.lit(error_class).alias("error_class"), F.lit(message).alias("message"))).otherwise(why)
    marked = docs.withColumn("_why", why)
    errors = marked.where("_why is not null").select(F.col(id_col).cast("string").alias("doc_id"), F.lit(stage).alias("stage"), "_why.error_class", "_why.message")
    return marked.where("_why is null").drop("_why"), errors


def handled(stage: str, run: Callable[[DataFrame], DataFrame], error_class: str = "ProcessingError") -> Callable[[DataFrame], DataFrame]:
    """``run`` whose failure while the plan is made says its stage and class."""

    def safe(docs: DataFrame) -> DataFrame:
        try:
            return run(docs)
        except Exception as error:
            raise RuntimeError(f"{stage}: {error_class}: {error}") from error

    return safe
