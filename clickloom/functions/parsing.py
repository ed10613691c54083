"""Multi-valued string fields: ``a;b;c`` lists and ``key:v1,v2;key:v3`` lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "-1"


def list_part(column: str, position: int) -> Column:
    """Text of the part at ``position`` (from 0) of a ``;`` list, null if there is none."""
    return F.get(F.split(column, ";"), F.lit(position))


def part_key(column: str, position: int) -> Column:
    """Text before the ``:`` of the part at ``position``, null if there is none."""
    return F.get(F.split(list_part(column, position), ":"), F.lit(0))


def as_id(part: Column, default: int = -1) -> Column:
    return F.coalesce(part.try_cast("bigint"), F.lit(default).cast("bigint"))


def category_ids(column: str = "item_category_list", names: Sequence[str] = ("cate_0", "cate_1", "cate_2")) -> dict[str, Column]:
    return {name: as_id(list_part(column, i)) for i, name in enumerate(names)}


def predicted_ids(column: str = "predict_category_property", names: Sequence[str] = ("pre_0", "pre_1", "pre_2")) -> dict[str, Column]:
    return {name: as_id(part_key(column, i)) for i, name in enumerate(names)}


def text_parts() -> dict[str, Column]:
    """Categories, properties and predicted categories kept as text, a blank where one is missing."""
    blank = F.lit(" ")
    parts: dict[str, Column] = {}
    for i in range(3):
        parts[f"category_{i}"] = F.coalesce(list_part("item_category_list", i), blank)
    for i in range(3):
        parts[f"property_{i}"] = F.coalesce(list_part("item_property_list", i), blank)
    for i in range(3):
        parts[f"predict_category_{i}"] = F.coalesce(part_key("predict_category_property", i), blank)
    return parts


def category_match(item: str = "category_1", predicted: Sequence[str] = ("predict_category_0", "predict_category_1", "predict_category_2")) -> Column:
    """1 if the item's category is one of the predicted ones."""
    return F.coalesce(F.col(item).isin(*[F.col(p) for p in predicted]), F.lit(False)).cast("int")


def property_overlap(item: str = "item_property_list", predicted: str = "predict_category_property") -> Column:
    """Share of the predicted properties that the item has, 0 where either side is empty."""
    wanted = F.array_distinct(
        F.flatten(
            F.transform(
                F.split(predicted, ";"),
                lambda part: F.coalesce(F.split(F.get(F.split(part, ":"), F.lit(1)), ","), F.array().cast("array<string>")),
            )
        )
    )
    wanted = F.array_remove(wanted, MISSING)
    owned = F.array_remove(F.array_distinct(F.split(item, ";")), MISSING)
    nothing_predicted = list_part(predicted, 0) == MISSING
    return F.when(
        nothing_predicted | (F.size(owned) == 0) | (F.size(wanted) == 0) | F.col(item).isNull() | F.col(predicted).isNull(),
        F.lit(0.0),
    ).otherwise(F.size(F.array_intersect(owned, wanted)) / F.size(wanted))
