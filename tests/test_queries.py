import pytest

import __spark_entry__ as driver
from tracegrid.plans import catalog

QUICK = ["conductor_normalize", "segment_intersections", "topology_nodes", "topology_edges", "page_components", "electrical_nets", "distribution_wires", "wires_pass1", "wires_pass2", "wire_merge", "terminal_candidates", "gap_candidates", "gap_bridges", "walk_stop_reasons", "masked_segments", "open_ends_after_masking", "snapped_points", "conductor_merge", "snapped_split_points", "snapped_topology_edges", "snapped_topology_nodes", "gap_ink_density", "inked_gap_bridges", "bridged_node_types", "bridged_wires", "coverage_nodes", "diagram_splices", "sorted_export", "splice_clusters", "stable_ids", "text_normalize", "text_classify", "provider_gate", "registry_lookup", "semantic_associations", "object_semantics", "role_observation_resolve", "endpoint_semantics", "boundary_resolution", "symbol_family", "electrical_components", "circuit_role_evidence", "wire_semantics", "geometry_ownership", "rejected_geometry_assoc", "terminal_location", "terminal_recognition", "connector_pins", "pin_endpoint_assoc", "ground_truth_match", "furniture_clusters", "wire_validation", "wire_model_findings", "wire_model_codes", "diagram_findings", "diagram_integrity", "diagram_json", "audit_counts", "audit_json", "directed_strokes", "net_validation", "coverage_conductors", "extraction_audit", "model_diff", "svg_fragments", "svg_validate", "recognition_json_scan", "recognition_tsv_scan", "scope_regions", "rle_open_segments", "scope_mask", "closed_ink", "outer_contours", "rectangle_measures", "circle_measures", "ground_symbols", "ground_bar_sequences", "blob_classify", "text_region_score", "text_region_groups", "text_components", "overlap_suppression", "endpoint_directed_ink", "conductor_ink_filter", "topology_json", "layered_svg", "review_layers"]


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, small, duck, same, name):
    same(catalog.QUERIES[name](spark, small), duck, catalog.ORACLE_SQL[name])


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_partitions_do_not_matter(spark, small, duck, same, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        same(catalog.QUERIES["wires_pass2"](spark, small), duck, catalog.ORACLE_SQL["wires_pass2"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sorted_export_holds_every_page(spark, small):
    rows = catalog.QUERIES["sorted_export"](spark, small).collect()
    nodes = catalog.QUERIES["topology_nodes"](spark, small)
    assert [(r.page, r.id) for r in rows] == sorted((r.page, r.id) for r in rows)
    assert len(rows) == nodes.count() and len({r.page for r in rows}) > 5


def test_every_rule_of_a_model_finds_its_fault(spark, small):
    found = {(r.code, r.severity) for r in catalog.QUERIES["wire_model_codes"](spark, f"{small[: -len('sf0.001')]}sf0.01").collect()}
    assert len([c for c, s in found if s == "error"]) == 15 and ("WIRE-GEOMETRIC-ENDPOINTS", "warning") in found
    codes = {r.code for r in catalog.QUERIES["diagram_findings"](spark, f"{small[: -len('sf0.001')]}sf0.01").select("code").distinct().collect()}
    assert len(codes) == 17
