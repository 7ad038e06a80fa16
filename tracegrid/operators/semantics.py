"""What recognised texts, terminals and registries say about drawn objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrid.functions import text
from tracegrid.functions.evidence import confidence_of, nearest_unique, pair_reinforced, rank, resolve_or_conflict, status_of, strongest_unless_tied
from tracegrid.functions.geometry import box_gap2, box_of
from tracegrid.operators.spatial import range_join
from tracegrid.operators.topology import PAGE

#: Distances of association: high, medium, and at most; confidence of recognised text: high, medium.
NEAR, MIDDLE, FAR = 12.0, 30.0, 80.0
TEXT_HIGH, TEXT_MEDIUM = 0.85, 0.70
ROLE_KINDS = {"ground_label": "ground", "power_feed_label": "power_feed", "shared_function_feed_label": "shared_function_feed"}
TERMINAL_KIND = {"chassis_ground": "ground_connection", "enclosure": "component_boundary", "circular_symbol": "component_boundary", "primitive_symbol": "connector_boundary"}

# Families by words in labels, and the component kinds that each may be.
FAMILY_RULES = [
    ("ground", ["GROUND", "GND"], ["chassis_ground", "enclosure", "circular_symbol"]),
    ("lamp", ["LAMP", "LIGHT", "INDICATOR", "HEADLIGHT", "TAILLIGHT", "BULB"], ["circular_symbol", "enclosure"]),
    ("switch", ["SWITCH"], ["circular_symbol", "enclosure", "primitive_symbol"]),
    ("relay", ["RELAY"], ["enclosure", "circular_symbol"]),
    ("motor", ["MOTOR"], ["circular_symbol", "enclosure"]),
    ("diode", ["DIODE", "RECTIFIER"], ["circular_symbol", "enclosure", "primitive_symbol"]),
    ("alternator", ["ALTERNATOR", "GENERATOR"], ["circular_symbol", "enclosure"]),
    ("battery", ["BATTERY"], ["enclosure"]),
    ("solenoid", ["SOLENOID"], ["enclosure", "circular_symbol"]),
    ("coil", ["COIL", "PULSE GENERATOR"], ["enclosure", "circular_symbol"]),
]


def map_column(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def provider_gate(observations: DataFrame, regions: DataFrame, provider: str = "recognition") -> DataFrame:
    """Observations of known regions with a text and a confidence; a missing provider is filled in."""
    known = regions.select(F.col("id").alias("text_region_id")).distinct()
    fine = observations.filter((F.col("raw_text") != "") & (F.col("confidence") != "unresolved"))
    return fine.join(known, "text_region_id", "left_semi").withColumn("provider", F.coalesce(F.nullif(F.col("provider"), F.lit("")), F.lit(provider)))


def interpret_texts(observations: DataFrame) -> DataFrame:
    """``observations`` with normalized_text and kind."""
    normal = observations.withColumn("normalized_text", text.normalize(F.col("raw_text")))
    return normal.withColumn("kind", text.classify(F.col("normalized_text")))


def association_confidence(d2: Column, text_confidence: Column) -> Column:
    near, middle = d2 <= NEAR * NEAR, d2 <= MIDDLE * MIDDLE
    high = near & (text_confidence >= TEXT_HIGH)
    medium = near | (middle & (text_confidence >= TEXT_MEDIUM))
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def associate(regions: DataFrame, components: DataFrame, endpoints: DataFrame, radius: float = FAR) -> DataFrame:
    """(page, text_region_id, target_id, target_kind, d2, confidence): texts with all objects within ``radius``."""
    left = regions.select(*PAGE, F.col("id").alias("text_region_id"), F.col("confidence").alias("tc"), *(F.col(c).alias(f"t_{c}") for c in ("bx", "by", "bw", "bh")))
    boxes = components.select(*PAGE, F.col("id").alias("target_id"), F.lit("component").alias("target_kind"), *(F.col(c).cast("double").alias(f"o_{c}") for c in ("bx", "by", "bw", "bh")))
    points = endpoints.select(*PAGE, F.col("id").alias("target_id"), F.lit("endpoint").alias("target_kind"), F.col("x").cast("double").alias("o_bx"), F.col("y").cast("double").alias("o_by"), F.lit(0.0).alias("o_bw"), F.lit(0.0).alias("o_bh"))
    met = range_join(left, boxes.unionByName(points), box_of("t_"), box_of("o_"), radius, PAGE, "text_region_id", "target_id", cell=160.0)
    met = met.withColumn("d2", box_gap2(box_of("t_"), box_of("o_"))).filter(F.col("d2") <= radius * radius)
    return met.select(*PAGE, "text_region_id", "target_id", "target_kind", "d2", "tc", association_confidence(F.col("d2"), F.col("tc")).alias("confidence"))


def object_candidates(texts: DataFrame, associations: DataFrame) -> DataFrame:
    """Known texts with the single nearest object of their region, at the weaker of both confidences."""
    named = associations.withColumn("target", F.concat_ws(":", "target_kind", "target_id"))
    nearest = nearest_unique(named, ["text_region_id"], "target", "d2").select("page", "text_region_id", "target_kind", "target_id", "d2", F.col("confidence").alias("ac"))
    met = texts.filter("kind <> 'unknown'").join(nearest, "text_region_id")
    return met.withColumn("confidence", confidence_of(F.least(rank(F.col("confidence")), rank(F.col("ac"))))).drop("ac")


def object_semantics(candidates: DataFrame) -> DataFrame:
    """One text for each object and kind: the strongest, unless equally strong texts differ."""
    return strongest_unless_tied(candidates, ["target_kind", "target_id", "kind"], "normalized_text", "confidence", [F.col("d2"), F.col("text_region_id")])


def role_observations(texts: DataFrame, associations: DataFrame) -> DataFrame:
    """(endpoint_id, role, confidence, d2, text_region_id) from role labels next to endpoints."""
    labels = texts.filter(F.col("kind").isin(*ROLE_KINDS))
    found = object_candidates(labels, associations.filter("target_kind = 'endpoint'"))
    return found.select(F.col("target_id").alias("endpoint_id"), map_column(ROLE_KINDS, F.col("kind")).alias("role"), "confidence", "d2", "text_region_id")


def resolve_roles(observations: DataFrame) -> DataFrame:
    """(endpoint_id, role, confidence): the strongest observation unless equally strong ones differ."""
    return strongest_unless_tied(observations, ["endpoint_id"], "role", "confidence", [F.col("d2"), F.col("text_region_id")]).select("endpoint_id", "role", "confidence")


def apply_labels(components: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(id, labels): the sorted distinct texts of each component."""
    texts = resolutions.filter("target_kind = 'component'").groupBy(F.col("target_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("normalized_text")), ",").alias("labels"))
    return components.select("id").join(texts, "id", "left").select("id", F.coalesce("labels", F.lit("")).alias("labels"))


def endpoint_labels(resolutions: DataFrame) -> DataFrame:
    """(endpoint_id, wire_color, function_label, terminal_name): the first resolution of each kind."""
    one = resolutions.filter("target_kind = 'endpoint'").groupBy(F.col("target_id").alias("endpoint_id"))
    first = lambda k: F.min(F.when(F.col("kind") == k, F.struct("text_region_id", "normalized_text")))["normalized_text"]
    return one.agg(first("wire_color").alias("wire_color"), first("function_label").alias("function_label"), first("terminal_label").alias("terminal_name"))


def endpoint_semantics(endpoints: DataFrame, evidence: DataFrame) -> DataFrame:
    """(endpoint_id, status, component_id, kind, confidence) of every endpoint; one conflict resets all its fields."""
    got = evidence.groupBy("endpoint_id").agg(F.min("component_id").alias("c0"), F.max("component_id").alias("c1"), F.min("kind").alias("k0"), F.max("kind").alias("k1"), F.max(rank(F.col("confidence"))).alias("r"))
    held = endpoints.select("endpoint_id").distinct().join(got, "endpoint_id", "left")
    fine = (F.col("c0") == F.col("c1")) & (F.col("k0") == F.col("k1"))
    status = F.when(F.col("r").isNull(), "unresolved").when(fine, "resolved").otherwise("conflicted")
    ok = status == "resolved"
    return held.select("endpoint_id", status.alias("status"), F.when(ok, F.col("c0")).alias("component_id"), F.when(ok, F.col("k0")).otherwise("geometric").alias("kind"), F.when(ok, confidence_of(F.col("r"))).otherwise("unresolved").alias("confidence"))


def first_terminal_evidence(endpoints: DataFrame, evidence: DataFrame) -> DataFrame:
    """(endpoint_id, component_id, kind, confidence): the first evidence in (component, kind) order, unless the
    endpoint is already highly confident and the evidence weaker. ``endpoints`` is (endpoint_id, confidence)."""
    w = Window.partitionBy("endpoint_id").orderBy("component_id", "kind", rank(F.col("ec")).desc())
    first = evidence.withColumnRenamed("confidence", "ec").withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")
    held = endpoints.join(first, "endpoint_id", "left")
    use = F.col("ec").isNotNull() & ~((F.col("confidence") == "high") & (rank(F.col("ec")) < 3))
    return held.select("endpoint_id", F.when(use, F.col("component_id")).alias("component_id"), F.when(use, F.col("kind")).otherwise("geometric").alias("kind"), F.when(use, F.col("ec")).otherwise(F.col("confidence")).alias("confidence"))


def connection_evidence(evidence: DataFrame) -> DataFrame:
    """(node_id, state, confidence): stronger evidence replaces weaker, equally strong contradictions cancel."""
    return strongest_unless_tied(evidence, ["node_id"], "state", "confidence", [F.col("state")]).select("node_id", "state", "confidence")


def identity_evidence(texts: DataFrame, associations: DataFrame) -> DataFrame:
    """(component_id, kind, normalized_text, confidence, d2): of equal texts the strongest, then the nearest."""
    met = texts.join(associations.filter("target_kind = 'component'").select("text_region_id", F.col("target_id").alias("component_id"), "d2"), "text_region_id")
    w = Window.partitionBy("component_id", "kind", "normalized_text").orderBy(rank(F.col("confidence")).desc(), "d2", "text_region_id")
    return met.withColumn("_i", F.row_number().over(w)).filter("_i = 1").select("component_id", "kind", "normalized_text", "confidence", "d2")


def identity_resolution(evidence: DataFrame) -> DataFrame:
    """(component_id, identity, status, confidence)."""
    one = resolve_or_conflict(evidence.withColumnRenamed("normalized_text", "identity"), ["component_id"], "identity")
    best = evidence.groupBy("component_id").agg(F.max(rank(F.col("confidence"))).alias("r"))
    return one.join(best, "component_id").select("component_id", "identity", "status", F.when(F.col("status") == "resolved", confidence_of(F.col("r"))).otherwise("unresolved").alias("confidence"))


def registry_index(registry: DataFrame) -> DataFrame:
    """(key, canonical_id, canonical_name): names that lead to one entry only."""
    names = registry.filter("canonical_id <> '' AND canonical_name <> ''").select("canonical_id", "canonical_name", F.explode(F.array_append("aliases", F.col("canonical_name"))).alias("alias"))
    keyed = names.withColumn("key", text.normalize_identity(F.col("alias"))).filter("key <> ''")
    return keyed.groupBy("key").agg(F.min("canonical_id").alias("canonical_id"), F.max("canonical_id").alias("_hi"), F.min("canonical_name").alias("canonical_name")).filter("canonical_id = _hi").drop("_hi")


def canonicalize(identities: DataFrame, index: DataFrame) -> DataFrame:
    """``identities`` (component_id, identity) with canonical_id, canonical_name and status."""
    keyed = identities.withColumn("key", text.normalize_identity(F.col("identity")))
    met = keyed.join(index, "key", "left")
    return met.select("component_id", "identity", "canonical_id", "canonical_name", F.when(F.col("canonical_id").isNull(), "not_found").otherwise("resolved").alias("status"))


def symbol_family(components: DataFrame, provider: DataFrame | None = None) -> DataFrame:
    """(id, family, status, confidence) from the component's kind, words of its label, and a provider's observations
    (id, family). A family stands on one piece of evidence of the first two sorts, or on two of the provider."""
    rules = components.sparkSession.createDataFrame([(f, w, k) for f, ws, ks in FAMILY_RULES for w in ws for k in ks], "family string, word string, kind string")
    worded = components.withColumn("u", text.ascii_upper(F.col("label"))).join(F.broadcast(rules), "kind").filter(F.contains("u", "word")).select("id", "family", F.lit(2).alias("strength"))
    made = components.filter("kind = 'chassis_ground'").select("id", F.lit("ground").alias("family"), F.lit(3).alias("strength"))
    told = worded.unionByName(made)
    if provider is not None:
        told = told.unionByName(provider.select("id", "family", F.lit(1).alias("strength")))
    strong = told.groupBy("id", "family").agg(F.max("strength").alias("s"), F.count(F.lit(1)).alias("n")).filter("s >= 2 OR n >= 2")
    per = strong.groupBy("id").agg(F.count(F.lit(1)).alias("families"), F.min("family").alias("family"), F.max("s").alias("s"))
    held = components.select("id", "kind").join(per, "id", "left")
    status = status_of(F.coalesce("families", F.lit(0)))
    return held.select("id", "kind", F.when(status == "resolved", F.col("family")).otherwise("unknown").alias("family"), status.alias("status"), F.when(status != "resolved", "unresolved").when(F.col("s") == 3, "high").otherwise("medium").alias("confidence"))


def electrical_components(families: DataFrame, terminals: DataFrame, connector_owned: DataFrame) -> DataFrame:
    """(id, status, rejection_reason, terminals): components with a terminal and a family other than ground.

    ``terminals`` is (id, endpoint_id), ``connector_owned`` (id).
    """
    counted = terminals.groupBy("id").agg(F.countDistinct("endpoint_id").alias("terminals"))
    held = families.join(counted, "id", "left").join(connector_owned.select("id").distinct().withColumn("owned", F.lit(True)), "id", "left")
    n = F.coalesce("terminals", F.lit(0)).cast("long")
    reason = F.when(F.col("kind") == "diagram_furniture", "diagram_furniture").when((F.col("kind") == "chassis_ground") | ((F.col("status") == "resolved") & (F.col("family") == "ground")), "chassis_ground_reference").when(F.col("owned"), "connector_interface").otherwise("not_applicable")
    status = F.when(reason != "not_applicable", "rejected").when((n >= 1) & (F.col("status") == "resolved"), "resolved").otherwise("unresolved")
    return held.select("id", status.alias("status"), reason.alias("rejection_reason"), n.alias("terminals"))


def terminal_semantic_evidence(terminals: DataFrame) -> DataFrame:
    """(endpoint_id, component_id, endpoint_kind, role, confidence) of terminal candidates; rows without ends drop."""
    kinds = {"component_boundary": "component_terminal", "connector_boundary": "connector_terminal", "ground_connection": "ground"}
    roles = {"component_boundary": "component_terminal", "connector_boundary": "connector_terminal", "ground_connection": "ground_terminal"}
    kept = terminals.filter("endpoint_id IS NOT NULL AND endpoint_id <> '' AND component_id IS NOT NULL AND component_id <> ''")
    return kept.select("endpoint_id", "component_id", F.coalesce(map_column(kinds, F.col("kind")), F.lit("unresolved")).alias("endpoint_kind"), F.coalesce(map_column(roles, F.col("kind")), F.lit("unknown")).alias("role"), "confidence")


def circuit_role_evidence(endpoints: DataFrame, labels: DataFrame) -> DataFrame:
    """(endpoint_id, role, source): what an endpoint is by itself, and its label if it names one role and does not
    contradict the first. ``labels`` is (endpoint_id, label)."""
    own = endpoints.filter("kind = 'ground'").select(F.col("id").alias("endpoint_id"), F.lit("ground").alias("role"))
    named = labels.withColumn("role", text.label_role(F.col("label"))).filter("role IS NOT NULL")
    one = resolve_or_conflict(named, ["endpoint_id"], "role").filter("status = 'resolved'").select("endpoint_id", "role")
    agreed = one.join(own.withColumnRenamed("role", "own"), "endpoint_id", "left").filter("own IS NULL OR own = role").drop("own")
    return own.withColumn("source", F.lit("intrinsic")).unionByName(agreed.withColumn("source", F.lit("label")))


def boundary_evidence(terminals: DataFrame, reconstructions: DataFrame) -> DataFrame:
    """(endpoint_id, category, component_id, status): what each source says an endpoint bounds."""
    a = terminals.select("endpoint_id", F.lit("terminal").alias("source"), F.when(F.col("kind") == "ground", "ground").when(F.col("kind") == "connector_terminal", "connector").otherwise("component").alias("category"), "component_id", F.lit("resolved").alias("status"))
    k = F.when(F.col("kind") == "ground", "ground").when(F.col("kind") == "connector_terminal", "connector").when(F.col("kind") == "component_terminal", "component")
    b = reconstructions.filter("status <> 'unresolved'").select("endpoint_id", F.lit("reconstruction").alias("source"), k.alias("category"), "component_id", "status")
    return a.unionByName(b).distinct()


def boundary_resolution(endpoints: DataFrame, evidence: DataFrame) -> DataFrame:
    """(endpoint_id, boundary_kind, boundary_status, component_status, component_id, ground_status, connector_status):
    every category for itself, then the kind if one category alone contributes."""
    c = F.col("category")
    distinct = lambda k: (F.min(F.when(c == k, F.col("component_id"))), F.max(F.when(c == k, F.col("component_id"))))
    got = evidence.groupBy("endpoint_id").agg(
        *(x.alias(f"{k}_{i}") for k in ("component", "ground", "connector") for i, x in enumerate(distinct(k))),
        F.max(F.col("status") == "conflicted").alias("doubt"),
    )
    held = endpoints.select("endpoint_id").distinct().join(got, "endpoint_id", "left")
    state = lambda k: F.when(F.col(f"{k}_0").isNull(), "unresolved").when(F.col(f"{k}_0") == F.col(f"{k}_1"), "resolved").otherwise("conflicted")
    n = sum((F.col(f"{k}_0").isNotNull().cast("int") for k in ("component", "ground", "connector")), F.lit(0))
    doubt = F.coalesce("doubt", F.lit(False))
    kind = F.when(n == 1, F.when(F.col("component_0").isNotNull(), "component").when(F.col("ground_0").isNotNull(), "ground").otherwise("connector"))
    status = F.when((n > 1) | doubt, "conflicted").when(n == 0, "unresolved").otherwise("resolved")
    return held.select("endpoint_id", F.when(status == "resolved", kind).otherwise("unresolved").alias("boundary_kind"), status.alias("boundary_status"), state("component").alias("component_status"), F.when(state("component") == "resolved", F.col("component_0")).alias("component_id"), state("ground").alias("ground_status"), state("connector").alias("connector_status"))


def wire_semantics(wires: DataFrame, labels: DataFrame) -> DataFrame:
    """(page, start_endpoint, end_endpoint, color and function with status and confidence) of wires, from the labels
    (endpoint_id, wire_color, function_label) at both ends."""
    side = lambda p, c: labels.select(F.col("endpoint_id").alias(c), F.col("wire_color").alias(f"{p}c"), F.col("function_label").alias(f"{p}f"))
    met = wires.join(side("a", "start_endpoint"), "start_endpoint", "left").join(side("b", "end_endpoint"), "end_endpoint", "left")
    color, function = pair_reinforced(F.col("ac"), F.col("bc")), pair_reinforced(F.col("af"), F.col("bf"))
    return met.select("page", "start_endpoint", "end_endpoint", color[0].alias("color"), color[1].alias("color_status"), color[2].alias("color_confidence"), function[0].alias("function"), function[1].alias("function_status"), function[2].alias("function_confidence"))
