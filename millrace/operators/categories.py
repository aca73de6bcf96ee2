"""Category by keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed keywords by category.
CATEGORIES = {
    "Electric Vehicle": ["motor", "battery", "controller", "charger", "e-bike", "e-motorcycle", "electric"],
    "Auto Parts": ["auto", "car", "wheel", "tire", "brake", "vehicle"],
    "Medical": ["medical", "syringe", "mask", "glove", "injection", "hospital"],
    "Chemicals": ["chemical", "material", "powder", "liquid", "acid", "solvent"],
    "Electronics": ["electronic", "chip", "pcb", "circuit", "power supply", "component"],
    "Office": ["office", "paper", "stationery", "desk", "supply"],
    "Other": [],
}


def predict_category(text: Column, categories: dict[str, list[str]] = CATEGORIES, default: str = "Other") -> Column:
    """The category whose matched keywords are longest together; of equal ones the greatest name."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scored = []
    for name, words in categories.items():
        if words:
            total = sum((F.when(low.contains(w), len(w)).otherwise(0) for w in words[1:]), F.when(low.contains(words[0]), len(words[0])).otherwise(0))
            scored.append(F.struct(total.alias("score"), F.lit(name).alias("name")))
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return F.when(best["score"] > 0, best["name"]).otherwise(F.lit(default))


def row_text(*columns: str) -> Column:
    return F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) for c in columns))


def category_rank(category: Column, order: list[str] | None = None) -> Column:
    ranks = F.create_map(*[F.lit(x) for i, n in enumerate(order or list(CATEGORIES)) for x in (n, i)])
    return F.coalesce(F.try_element_at(ranks, category), F.lit(999))
