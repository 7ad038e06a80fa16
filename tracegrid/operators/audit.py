"""The audit of an extraction: how many of each kind of object a page has, in one sum over all tables.

Every table gives rows (page, measure, n), one for each measure that an object counts in, and all of them meet in a single
shuffle by page and measure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.topology import PAGE

#: Measures by the value of a column: (table, column, measure of every row or none, measures by value).
BY_VALUE = [
    ("nodes", "type", "topology_nodes", {"conductor_end": "conductor_end_nodes", "continuation": "continuation_nodes", "junction": "junction_nodes", "splice": "splice_nodes", "crossing": "crossing_nodes", "component_boundary": "component_boundary_nodes", "unresolved": "unresolved_nodes"}),
    ("endpoints", "kind", "endpoint_candidates", {"geometric": "geometric_endpoints", "component_terminal": "component_terminals", "connector_terminal": "connector_terminals", "ground": "ground_endpoints", "external_connection": "external_connections", "splice": "splice_endpoints", "unresolved": "unresolved_endpoints"}),
    ("components", "kind", "shapes", {"enclosure": "enclosure_shapes", "circular_symbol": "circular_shapes", "chassis_ground": "chassis_ground_shapes", "primitive_symbol": "primitive_shapes", "diagram_furniture": "diagram_furniture_shapes", "unknown": "unknown_shapes"}),
    ("nets", "role", "electrical_nets", {"ground": "ground_nets", "power_feed": "power_feed_nets", "shared_function_feed": "shared_function_feed_nets", "unknown": "unresolved_nets"}),
    ("primitives", "kind", "symbol_primitives", {"line": "symbol_primitive_lines", "circle": "symbol_primitive_circles", "rectangle": "symbol_primitive_rectangles", "terminal_lead": "symbol_primitive_terminal_leads", "unknown": "symbol_primitive_unknown"}),
    ("findings", "severity", None, {"error": "validation_errors", "warning": "validation_warnings"}),
    ("wire_semantics", "color_status", "wire_semantics", {s: f"wire_color_{s}" for s in ("resolved", "conflicted", "unresolved")}),
    ("wire_semantics", "function_status", None, {s: f"function_{s}" for s in ("resolved", "conflicted", "unresolved")}),
    ("wire_semantics", "net_status", None, {s: f"electrical_net_{s}" for s in ("resolved", "conflicted", "unresolved")}),
    ("families", "status", "symbol_families", {"resolved": "families_resolved", "conflicted": "families_conflicted", "unresolved": "families_unresolved"}),
    ("electrical_components", "status", "electrical_components", {"resolved": "electrical_resolved", "unresolved": "electrical_unresolved", "rejected": "electrical_rejected"}),
    ("electrical_components", "rejection", None, {"diagram_furniture": "rejected_diagram_furniture", "chassis_ground": "rejected_chassis_ground_reference", "primitive_symbol": "rejected_connector_interface"}),
    ("boundaries", "status", "conductor_boundaries", {"resolved": "boundaries_resolved", "unresolved": "boundaries_unresolved", "conflicted": "boundaries_conflicted"}),
]
#: Tables of which only the rows are counted.
COUNTED = {"conductors": "conductor_segments", "edges": "topology_edges", "wires": "wires", "pins": "connector_pins", "bridges": "gaps_bridged"}
FAMILIES = ("ground", "lamp", "switch", "relay", "motor", "diode", "alternator", "battery", "solenoid", "coil", "fuse")
#: Measures that hang on more than one value.
OTHERS = ["heavy_cable_wires", "unresolved_wires", "valid_wires", "components_with_symbol_geometry", "components_without_symbol_geometry", "component_association_resolved", "component_association_conflicted", "component_association_unresolved", "connector_association_resolved", "wires_fully_unresolved", *(f"{f}_resolved" for f in FAMILIES)]
MEASURES = sorted({*COUNTED.values(), *OTHERS, *(m for _, _, whole, by in BY_VALUE for m in (whole, *by.values()) if m)})


def _rows(df: DataFrame, *measures: Column, n: Column | None = None) -> DataFrame:
    each = df.select(*PAGE, F.explode(F.array(*measures)).alias("measure"), (F.lit(1) if n is None else n).cast("long").alias("n"))
    return each.filter("measure IS NOT NULL")


def _mapped(column: str, by: dict[str, str]) -> Column:
    value = F.lit(None).cast("string")
    for k, v in by.items():
        value = F.when(F.col(column) == k, v).otherwise(value)
    return value


def audit_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(page, measure, n) for every measure and page of the conductors; a table that is not there counts as empty.

    Tables are (page, ...) with the columns that ``BY_VALUE`` names; wires also have heavy, confidence and valid, findings n,
    geometries primitives (how many), wire semantics the status of each end's component and connector, families family.
    """
    parts = [_rows(tables[t], F.lit(name)) for t, name in COUNTED.items() if t in tables]
    for table, column, whole, by in BY_VALUE:
        if table in tables:
            measures = [_mapped(column, by)] + ([F.lit(whole)] if whole else [])
            parts.append(_rows(tables[table], *measures, n=F.col("n") if table == "findings" else None))
    if "wires" in tables:
        parts.append(_rows(tables["wires"], F.when(F.col("heavy"), "heavy_cable_wires"), F.when(F.col("confidence") == "unresolved", "unresolved_wires"), F.when(F.col("valid"), "valid_wires")))
    if "geometries" in tables:
        parts.append(_rows(tables["geometries"], F.when(F.col("primitives") > 0, "components_with_symbol_geometry").otherwise("components_without_symbol_geometry")))
    if "wire_semantics" in tables:
        either = lambda what, s: (F.col(f"start_{what}") == s) | (F.col(f"end_{what}") == s)
        component = F.when(either("component", "resolved"), "resolved").when(either("component", "conflicted"), "conflicted").otherwise("unresolved")
        some = either("component", "resolved") | either("connector", "resolved") | (F.col("color_status") == "resolved") | (F.col("function_status") == "resolved") | (F.col("net_status") == "resolved")
        parts.append(_rows(tables["wire_semantics"], F.concat(F.lit("component_association_"), component), F.when(either("connector", "resolved"), "connector_association_resolved"), F.when(~some, "wires_fully_unresolved")))
    if "families" in tables:
        parts.append(_rows(tables["families"].filter(F.col("status") == "resolved"), F.when(F.col("family").isin(*FAMILIES), F.concat("family", F.lit("_resolved")))))
    counted = reduce(DataFrame.unionByName, parts).groupBy(*PAGE, "measure").agg(F.sum("n").alias("n"))
    pages = tables["conductors"].select(*PAGE).distinct().select(*PAGE, F.explode(F.array(*(F.lit(m) for m in MEASURES))).alias("measure"))
    return pages.join(counted, [*PAGE, "measure"], "left").select(*PAGE, "measure", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def audit_json(counts: DataFrame, warnings: DataFrame) -> DataFrame:
    """(page, json): a page's audit as one document, measures in order of name and then its warnings (page, code, n) by code."""
    listed = counts.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("measure", "n"))).alias("m"))
    told = warnings.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("w"))
    return listed.join(told, list(PAGE), "left").select(*PAGE, F.to_json(F.struct("page", F.map_from_entries("m").alias("counts"), F.coalesce("w", F.array().cast("array<struct<code:string,n:bigint>>")).alias("validation_warnings"))).alias("json"))
