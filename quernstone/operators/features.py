"""The 52 pocket features, by native aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import finite_rows
from ..functions import exprs as e
from ..functions import vocab as v


def fractions(df: DataFrame, by: list[str], code: str, words: tuple[str, ...], prefix: str) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg((F.col(code) == w).cast("double")).alias(prefix + w) for w in words))


def moments(atoms: DataFrame, by: list[str]) -> DataFrame:
    """Radius of gyration, largest radius, extents and standard deviations along the principal axes."""
    centre = atoms.groupBy(*by).agg(*(F.avg(a).alias("m" + a) for a in "xyz"))
    d = atoms.join(centre, by).withColumns({a: F.col(a) - F.col("m" + a) for a in "xyz"})
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    cov = [F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    s = d.groupBy(*by).agg(F.count("*").alias("atoms"), F.sqrt(F.avg(r2)).alias("gyration"), F.sqrt(F.max(r2)).alias("max_radius"), F.sort_array(F.array(*(F.max(a) - F.min(a) for a in "xyz")), False).alias("box"), *cov)
    out = e.with_eigen(s)
    return out.select(
        *by, "atoms", F.col("gyration").alias("coord_radius_of_gyration"), F.col("max_radius").alias("coord_max_radius"),
        *(F.col("box")[i].alias(f"bbox_extent_{n}") for i, n in enumerate(("large", "mid", "small"))),
        *(F.col(f"std_{n}").alias(f"coord_std_{n}") for n in ("large", "mid", "small")),
    )


def centroids(atoms: DataFrame, by: list[str]) -> DataFrame:
    return atoms.groupBy(*by, "seq_id").agg(*(F.avg(a).alias(a) for a in "xyz"))


def centroid_pairs(residues: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of positions of one pocket with their distance, rounded half to even at 8 places."""
    other = residues.select(*by, F.col("seq_id").alias("other"), *(F.col(a).alias("r" + a) for a in "xyz"))
    return residues.join(other, by).where("seq_id < other").withColumn("d", F.bround(e.distance(*((F.col(a), F.col("r" + a)) for a in "xyz")), 8))


def histogram(pairs: DataFrame, by: list[str]) -> DataFrame:
    d = F.col("d")
    return pairs.groupBy(*by).agg(*(F.avg(((d >= lo) & (d < hi)).cast("double")).alias(f"residue_pair_distance_bin_{i}") for i, (lo, hi) in enumerate(zip(v.PAIR_BINS, v.PAIR_BINS[1:]))))


def contact_graph(residues: DataFrame, pairs: DataFrame, by: list[str], cutoff: float = v.GRAPH_CUTOFF) -> DataFrame:
    """Edge density, mean degree and its standard deviation; positions without a contact count with degree 0."""
    ends = pairs.where(F.col("d") <= cutoff).select(*by, F.explode(F.array("seq_id", "other")).alias("seq_id")).groupBy(*by, "seq_id").agg(F.count("*").alias("degree"))
    all_ = residues.select(*by, "seq_id").join(ends, [*by, "seq_id"], "left").fillna(0, ["degree"])
    n = F.count("*")
    return all_.groupBy(*by).agg(
        F.when(n > 1, F.sum("degree") / (n * (n - 1))).otherwise(0.0).alias("residue_contact_edge_density_8A"),
        F.avg("degree").alias("residue_contact_mean_degree_8A"), F.stddev_pop("degree").alias("residue_contact_degree_std_8A"),
    )


def pocket_features(atoms: DataFrame, coverage: DataFrame, by: list[str]) -> DataFrame:
    """by and the 52 features of each pocket. atoms: its heavy atoms; coverage: by and the share of expected positions.

    Atoms are dealt out once, by pocket; everything else follows inside of that
    partitioning. A pocket with a value that is not finite fails the query.
    """
    own = atoms.select(*by, "seq_id", "residue_name", "element", "x", "y", "z").repartition(*by)
    pocket = Window.partitionBy(*by)
    off = own.withColumns({"m" + a: F.avg(a).over(pocket) for a in "xyz"}).withColumns({"d" + a: F.col(a) - F.col("m" + a) for a in "xyz"}).withColumn("class", e.element_class(F.col("element")))
    r2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    whole = e.with_eigen(
        off.groupBy(*by).agg(
            F.count("*").cast("double").alias("pocket_atom_count"), F.sqrt(F.avg(r2)).alias("coord_radius_of_gyration"), F.sqrt(F.max(r2)).alias("coord_max_radius"),
            F.sort_array(F.array(*(F.max(a) - F.min(a) for a in "xyz")), False).alias("box"), *(F.avg(F.col("d" + a) * F.col("d" + b)).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")),
            *(F.avg((F.col("class") == w).cast("double")).alias(f"element_fraction_{w}") for w in v.ELEMENT_ORDER),
        )
    )
    shown = {f"bbox_extent_{n}": F.col("box")[i] for i, n in enumerate(("large", "mid", "small"))} | {f"coord_std_{n}": F.col(f"std_{n}") for n in ("large", "mid", "small")}
    res = own.where("seq_id is not null").groupBy(*by, "seq_id").agg(F.mode("residue_name", True).alias("residue_name"), *(F.avg(a).alias(a) for a in "xyz")).withColumn("code", e.one_letter(F.col("residue_name")))
    places = res.select(*by, "seq_id", "x", "y", "z")
    names = res.groupBy(*by).agg(F.count("*").cast("double").alias("pocket_residue_count"), *(F.avg((F.col("code") == w).cast("double")).alias(f"aa_fraction_{w}") for w in v.AA_ORDER))
    other = places.select(*by, F.col("seq_id").alias("other"), *(F.col(a).alias("r" + a) for a in "xyz"))
    d = F.bround(e.distance(*((F.col(a), F.col("r" + a)) for a in "xyz")), 8)
    pairs = places.join(other, by).withColumn("d", F.when(F.col("seq_id") != F.col("other"), d)).withColumn("once", F.when(F.col("seq_id") < F.col("other"), F.col("d")))
    each = pairs.groupBy(*by, "seq_id").agg(
        F.count_if(F.col("d") <= v.GRAPH_CUTOFF).alias("degree"), F.count("once").alias("pairs"),
        *(F.count_if((F.col("once") >= lo) & (F.col("once") < hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(zip(v.PAIR_BINS, v.PAIR_BINS[1:]))),
    )
    n, all_pairs = F.count("*"), F.sum("pairs")
    graph = each.groupBy(*by).agg(
        *(F.when(all_pairs > 0, F.sum(f"b{i}") / all_pairs).otherwise(0.0).alias(f"residue_pair_distance_bin_{i}") for i in range(9)),
        F.when(n > 1, F.sum("degree") / (n * (n - 1))).otherwise(0.0).alias("residue_contact_edge_density_8A"),
        F.avg("degree").alias("residue_contact_mean_degree_8A"), F.stddev_pop("degree").alias("residue_contact_degree_std_8A"),
    )
    all_ = whole.withColumns(shown).join(names, by).join(graph, by).join(coverage.select(*by, F.col("coverage").alias("pocket_position_coverage")), by)
    out = all_.withColumn("pocket_missing_fraction", 1 - F.col("pocket_position_coverage")).select(*by, *v.FEATURE_NAMES)
    return finite_rows(out, out.columns[len(by) :], v.FEATURE_NAMES)
