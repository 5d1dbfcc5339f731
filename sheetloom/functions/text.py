"""Text analytics of documents as column expressions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
TYPE_TERMS: dict[str, list[str]] = {
    "architectural_plan": ["floor plan", "elevation", "building section", "key plan", "ada", "architectural", "drawing", "plan view", "section view"],
    "construction_specification": ["section", "division", "astm", "part 1", "part 2", "part 3", "specification", "submittal", "quality assurance", "execution"],
    "engineering_design": ["structural", "foundation", "framing", "load", "design criteria", "analysis", "calculation", "engineering", "structural design"],
    "building_code": ["building code", "fire code", "occupancy", "construction type", "ibc", "obc", "code compliance", "regulatory"],
    "fire_protection": ["fire protection", "sprinkler", "nfpa", "fire alarm", "fire rating", "fire resistance", "fire safety", "suppression"],
    "material_specification": ["material", "product data", "manufacturer", "grade", "type", "specification sheet", "material properties", "performance"],
    "technical_manual": ["manual", "installation", "procedure", "maintenance", "operation", "instructions", "technical guide", "handbook"],
}
COMPLEXITY_TERMS: dict[str, tuple[int, list[str]]] = {
    "simple": (1, ["summary", "general", "basic", "overview", "introduction"]),
    "moderate": (1, ["specification", "detail", "requirements", "standard", "procedure"]),
    "complex": (2, ["engineering", "structural", "technical", "analysis", "calculation"]),
    "very_complex": (3, ["seismic", "load analysis", "finite element", "computational", "advanced"]),
}
LANGUAGE_TERMS: dict[str, list[str]] = {
    "regulatory": ["shall", "comply", "conform", "required", "mandatory", "must"],
    "technical": ["specification", "standard", "grade", "type", "class", "performance"],
    "procedural": ["install", "apply", "prepare", "clean", "provide", "execute"],
    "quality": ["quality", "assurance", "control", "inspection", "testing", "verification"],
    "safety": ["safety", "hazard", "warning", "caution", "protection", "emergency"],
    "instructional": ["shall", "should", "must", "required", "ensure", "verify"],
}
ENGINEERING_TERMS: dict[str, list[str]] = {
    "codes": ["IBC", "OBC", "NFPA", "ASTM", "AISI", "ANSI", "AWS", "AISC"],
    "materials": ["Grade", "gauge", "steel", "concrete", "aluminum", "wood"],
    "units": ["SF", "ft", "in", "mm", "psf", "PSF", "ksi", "MPa"],
    "standards": ["ASCE", "AWS", "AISC", "TMS", "ANSI", "UL", "FM"],
    "fire": ["sprinkler", "NFPA", "fire", "rating", "resistance"],
    "structure": ["beam", "column", "joist", "truss", "foundation", "footing"],
}
#: Patterns whose occurrences speak five times for a specification.
TYPE_PATTERNS = (r"section\s+\d+", r"division\s+\d+")
FLAGS = {
    "has_technical_drawings": r"elevation|plan|section|detail|drawing",
    "has_specifications": r"specification|astm|section \d+",
    "has_building_codes": r"building code|ibc|obc|nfpa",
    "has_dimensions": r"\d+(?:\.\d+)?\s*(?:ft|in|mm|sf)",
    "has_materials": r"steel|concrete|wood|masonry|aluminum",
    "has_fire_protection": r"fire|sprinkler|nfpa|suppression",
    "has_structural_elements": r"beam|column|joist|truss|foundation",
    "has_load_requirements": r"load|psf|psi|ksi|mpa",
}
STRUCTURE = {
    "paragraph_count": r"\n\s*\n",
    "section_headers": r"(?md)^[A-Z\s]+:?\s*$",
    "numbered_items": r"(?md)^\s*\d+[\.\)]\s+",
    "bullet_points": r"(?md)^\s*[•\-\*]\s+",
}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where generated code would repeat it for every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(lowered: Column, terms: list[str]) -> Column:
    """How many of the terms occur in the text, however often."""
    return sum((F.contains(lowered, F.lit(t)).cast("int") for t in terms), F.lit(0))


def first_best(scores: list[tuple[str, Column]], default: str) -> Column:
    """The name of the highest positive score, the first among equals. Each score is computed once."""
    candidate = lambda score, place, name: F.struct(score.cast("int").alias("score"), F.lit(place).alias("place"), F.lit(name).alias("name"))
    return F.array_max(F.array(candidate(F.lit(0), 1, default), *[candidate(score, -k, name) for k, (name, score) in enumerate(scores)]))["name"]


def document_type(text: Column) -> Column:
    def best(low: Column) -> Column:
        scores = []
        for name, terms in TYPE_TERMS.items():
            score = present(low, terms)
            if name == "construction_specification":
                score = score + 5 * sum((F.regexp_count(low, F.lit(p)) for p in TYPE_PATTERNS), F.lit(0))
            scores.append((name, score))
        return first_best(scores, "general")

    return bound(F.lower(text), best)


def complexity(text: Column) -> Column:
    return bound(F.lower(text), lambda low: first_best([(name, weight * present(low, terms)) for name, (weight, terms) in COMPLEXITY_TERMS.items()], "simple"))


def language_indicators(text: Column) -> Column:
    return bound(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(present(low, terms) > 0, name) for name, terms in LANGUAGE_TERMS.items()])))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def technical_density(text: Column) -> Column:
    """Occurrences of terms inside words, per word; a term that is listed twice counts twice. One pass over the words."""
    weights = Counter(t.lower() for terms in ENGINEERING_TERMS.values() for t in terms)

    def add(seen: Column, word: Column) -> Column:
        hits = sum((n * F.contains(word, F.lit(t)).cast("int") for t, n in weights.items()), F.lit(0))
        return F.when(word == "", seen).otherwise(F.struct((seen["n"] + 1).alias("n"), (seen["hits"] + hits).alias("hits")))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("hits"))
    density = lambda seen: F.when(seen["n"] > 0, seen["hits"] / seen["n"]).otherwise(0.0)
    return F.aggregate(F.split(F.lower(text), r"(?U)[\s\x1c-\x1f]+"), start, add, density)


def flags(text: Column) -> dict[str, Column]:
    return {name: F.lower(text).rlike(pattern) for name, pattern in FLAGS.items()}


def characteristics(text: Column) -> Column:
    own = [c.alias(name) for name, c in flags(text).items()]
    return F.struct(*own, complexity(text).alias("document_complexity"), language_indicators(text).alias("language_indicators"), technical_density(text).alias("technical_density"))


def structure(text: Column) -> dict[str, Column]:
    """Counts of layout features, mean words per sentence and reading class."""
    counts = {name: F.regexp_count(text, F.lit(pattern)) for name, pattern in STRUCTURE.items()}
    sentences = F.split(text, "[.!?]+", -1)
    mean = F.aggregate(sentences, F.lit(0), lambda n, s: n + F.size(words(s))) / F.size(sentences)
    level = F.when(mean > 25, "high").when(mean > 15, "medium").otherwise("low")
    return counts | {"avg_sentence_length": mean, "reading_complexity": level}


def preview(text: Column, n: int = 500) -> Column:
    return F.concat(F.left(text, F.lit(n)), F.when(F.char_length(text) > n, "...").otherwise(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
