"""Site positions carried over by an alignment, the gates on it, and the status of a predicted view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as e
from .tables import waterfall

VIEW_STATUS = ("alphafold_record_unavailable", "sequence_mapping_threshold_failure", "coordinate_mapping_failure", "site_plddt_threshold_failure", "eligible")


def with_site(df: DataFrame, alignment: str = "alignment", positions: str = "positions", query: str = "construct_sequence", target: str = "sequence") -> DataFrame:
    """Add site_map (site positions that the alignment carries, with their targets), site_coverage and site_identity.

    The alignment is a struct with pairs, a map of 1-based positions. A site without
    positions has coverage null; a map without entries has identity 0.
    """
    pairs = F.col(f"{alignment}.pairs")
    at = F.filter(F.col(positions), lambda p: F.array_contains(F.map_keys(pairs), p))
    out = df.withColumn("site_map", F.map_from_arrays(F.array_distinct(at), F.transform(F.array_distinct(at), lambda p: F.element_at(pairs, p))))
    letter = lambda text, p: F.substring(F.col(text), p, F.lit(1))
    same = F.size(F.filter(F.map_keys("site_map"), lambda p: letter(query, p) == letter(target, F.element_at(F.col("site_map"), p))))
    n = F.size("site_map")
    return out.withColumns({"site_coverage": n / F.nullif(F.size(positions), F.lit(0)), "site_identity": F.when(n > 0, same / n).otherwise(0.0)})


def metrics(alignment: str = "alignment") -> Column:
    """The alignment without its map."""
    return F.col(alignment).dropFields("pairs")


def site_map_text() -> Column:
    """The site's map with its keys in ascending order, as from:to;from:to."""
    keys = F.array_sort(F.map_keys("site_map"))
    return F.array_join(F.transform(keys, lambda k: F.concat_ws(":", k, F.element_at(F.col("site_map"), k))), ";")


def mapping_gate(coverage: float, identity: float, site_coverage: float, site_identity: float | None = None, alignment: str = "alignment") -> Column:
    """Whether an alignment is good enough; predicted views ask for the site's identity as well. What is not known fails."""
    ok = (F.col(f"{alignment}.coverage") >= coverage) & (F.col(f"{alignment}.identity") >= identity) & (F.col("site_coverage") >= site_coverage)
    if site_identity is not None:
        ok = ok & (F.col("site_identity") >= site_identity)
    return F.coalesce(ok, F.lit(False))


def view_status(has_record: Column, mapped: Column, gate: Column, plddt: Column, minimum: float) -> Column:
    """The first reason why a predicted view is not eligible, in the order in which they are looked at."""
    low = plddt.isNull() | F.isnan(plddt) | (F.abs(plddt) == float("inf")) | (plddt < minimum)
    return waterfall([(~has_record, VIEW_STATUS[0]), (~mapped, VIEW_STATUS[1]), (F.coalesce(gate != "pass", F.lit(True)), VIEW_STATUS[2]), (low, VIEW_STATUS[3])], VIEW_STATUS[4])


def target_names(df: DataFrame, key: str, target: str = "sequence") -> DataFrame:
    """(pdb_id as key, seq_id, expected_name): the target positions of a site map with the names that its sequence gives them."""
    one = df.select(F.col(key).alias("pdb_id"), target, F.explode(F.array_distinct(F.map_values("site_map"))).alias("seq_id"))
    return one.select("pdb_id", "seq_id", e.three_letter(F.substring(F.col(target), F.col("seq_id"), F.lit(1))).alias("expected_name"))


#: The columns of a fixed view's row that another view replaces.
REPLACED = (
    "view_id", "mapping_tier", "feature_structure_pdb_id", "feature_structure_sha256", "feature_protein_entity_id", "feature_protein_asym_id",
    "pocket_positions_label_seq_id", "present_positions_label_seq_id", "missing_positions_label_seq_id", "receptor_conformation_source",
    "query_holo_receptor_privilege", "historical_reference_ligand_used_only_for_site", "query_ligand_coordinates_read",
)


def override(template: DataFrame, view: DataFrame, on: str, tier: str, source: str, features: tuple[str, ...]) -> DataFrame:
    """Rows of the template for another view: 13 columns replaced, features spliced in, everything else and the order of columns as before.

    view: on, structure_id, structure_sha256, entity_id, asym_id, three position
    arrays (expected, present, missing) and the features; rows without a view go.
    """
    new = view.select(F.col(on).alias("__on"), F.struct(*(c for c in view.columns if c != on)).alias("__v"))
    joined = template.join(new, F.col(on) == F.col("__on"))
    joined_ids = lambda c: F.array_join(F.col(f"__v.{c}"), ";")
    values = (
        F.concat("observation_id", F.lit(":" + tier)), F.lit(tier), F.col("__v.structure_id"), F.col("__v.structure_sha256"), F.col("__v.entity_id"), F.col("__v.asym_id"),
        joined_ids("expected"), joined_ids("present"), joined_ids("missing"), F.lit(source), F.lit(False), F.lit(True), F.lit(False),
    )
    changed = dict(zip(REPLACED, values)) | {f: F.col(f"__v.{f}") for f in features}
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in template.columns), *(x.alias(c) for c, x in changed.items() if c not in template.columns))


def fixed_rows(views: DataFrame) -> DataFrame:
    """The S1 rows, which are the templates of other views."""
    return views.where("mapping_tier = 'S1'")
