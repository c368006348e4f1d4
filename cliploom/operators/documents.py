"""JSON documents as columns: guards, records, objects, strict parsing, canonical equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind_of(text: Column) -> Column:
    """object, array, string, number, boolean or null; null for what is no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(F.startswith(kind, F.lit("OBJECT")), "object")
        .when(F.startswith(kind, F.lit("ARRAY")), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.isNotNull(), "number")
    )


def records(text: Column, shape: str) -> Column:
    """Records of a JSON array, as structs; null for what is none."""
    return F.when(kind_of(text) == "array", F.from_json(text, shape))


def ordered_list(value: Column, *order: Column) -> Column:
    """Aggregate: values in order; an empty list for none."""
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(ranked)), lambda x: x["v"])


def object_of(key: Column, value: Column) -> Column:
    """Aggregate: a JSON object with keys in order. A key that comes twice ends the run."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))))


def strict(text: Column, shape: str, keys: list[str], checks) -> Column:
    """The struct of an object that has exactly these keys and passes checks(struct); null otherwise. NaN and Infinity are no
    JSON."""
    parsed = F.from_json(text, shape, {"allowNonNumericNumbers": "false"})
    exact = (kind_of(text) == "object") & (F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(k) for k in sorted(keys)]))
    return F.when(exact & F.coalesce(checks(parsed), F.lit(False)), parsed)


def same_document(a: Column, b: Column, shape: str) -> Column:
    """Equality of two objects of a known shape, whatever the order of their keys; arrays are equal in order."""
    return F.from_json(a, shape).eqNullSafe(F.from_json(b, shape)) & (F.array_sort(F.json_object_keys(a)).eqNullSafe(F.array_sort(F.json_object_keys(b))))


def cells_sum(grid: Column, cells: Column, factor: Column) -> Column:
    """Sum of the grid's cells (rows of columns) at places (r, c), times a factor, to three decimals; places outside are 0."""
    total = F.aggregate(cells, F.lit(0.0), lambda acc, p: acc + F.coalesce(F.get(F.get(grid, p["r"].cast("int")), p["c"].cast("int")).cast("double"), F.lit(0.0)))
    return F.round(total * factor, 3) + 0.0  # no negative zero


def union_box(detections: Column, label: Column, least: float) -> Column:
    """Smallest box around the detections of a class that are sure enough; null for none."""
    some = F.filter(detections, lambda d: (d["label"] == label) & (d["score"] >= least))
    edge = lambda f, pick: pick(F.transform(some, lambda d: d[f]))
    box = F.struct(edge("x0", F.array_min).alias("x0"), edge("y0", F.array_min).alias("y0"), edge("x1", F.array_max).alias("x1"), edge("y1", F.array_max).alias("y1"))
    return F.when(F.size(some) > 0, box)
