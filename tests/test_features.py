import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import exprs as e
from quernstone.functions import vocab as v
from quernstone.operators import atoms, features, tables

COLS = "pdb_id string, entity_id string, asym_id string, seq_id int, atom_name string, alt_id string, residue_name string, element string, `group` string, occupancy double, b_factor double, x double, y double, z double, ord long"
#: A small pocket: position, residue, atoms as (name, element, place on a lattice).
POCKET = (
    (3, "TRP", (("CA", "C", (0, 0, 0)), ("CB", "C", (1, 2, 0)), ("NE1", "N", (2, 3, 1)))),
    (8, "MSE", (("CA", "C", (5, 1, 2)), ("SE", "SE", (6, 2, 4)))),
    (9, "ASN", (("CA", "C", (4, 6, 1)), ("OD1", "O", (5, 7, 3)))),
    (21, "QQQ", (("CA", "C", (-9, 4, 8)), ("ZN", "ZN", (-10, 5, 9)), ("P", "P", (-9, 6, 9)))),
    (40, "CYS", (("CA", "C", (12, -20, 7)), ("SG", "S", (13, -21, 6)))),
)
BY = ["pdb_id", "asym_id"]


def pocket(spark, turn=np.eye(3), shift=(0, 0, 0), more=()):
    rows = []
    for seq, name, own in POCKET:
        for atom, element, place in own:
            x, y, z = (turn @ np.array(place, float) + shift).tolist()
            rows.append(("T", "1", "K", seq, atom, "", name, element, "ATOM", 1.0, 9.0, x, y, z, len(rows)))
    return spark.createDataFrame([*rows, *more], COLS)


def by_hand():
    """The 52 features of the pocket by array arithmetic."""
    xyz = np.array([p for _, _, own in POCKET for _, _, p in own], float)
    kinds = [k for _, _, own in POCKET for _, k, _ in own]
    off = xyz - xyz.mean(0)
    out = {"pocket_residue_count": 5, "pocket_atom_count": 12, "pocket_position_coverage": 5 / 6, "pocket_missing_fraction": 1 / 6}
    out |= {f"aa_fraction_{a}": 0.2 * "WMNXC".count(a) for a in v.AA_ORDER}
    out |= {f"element_fraction_{k}": kinds.count(k) / 12 for k in v.ELEMENT_ORDER[:-1]} | {"element_fraction_OTHER": kinds.count("ZN") / 12}
    out["coord_radius_of_gyration"], out["coord_max_radius"] = np.sqrt((off**2).sum(1).mean()), np.sqrt((off**2).sum(1).max())
    out |= dict(zip(("bbox_extent_large", "bbox_extent_mid", "bbox_extent_small"), sorted(np.ptp(xyz, axis=0), reverse=True)))
    out |= dict(zip(("coord_std_large", "coord_std_mid", "coord_std_small"), np.sqrt(np.linalg.eigvalsh(off.T @ off / 12)[::-1])))
    centre = np.array([np.mean([p for *_, p in own], axis=0) for _, _, own in POCKET])
    d = np.linalg.norm(centre[:, None] - centre[None], axis=2)
    pairs = d[np.triu_indices(5, 1)]
    for i, (lo, hi) in enumerate(zip(v.PAIR_BINS, v.PAIR_BINS[1:])):
        out[f"residue_pair_distance_bin_{i}"] = np.mean((pairs >= lo) & (pairs < hi))
    degree = ((d <= 8) & ~np.eye(5, dtype=bool)).sum(1)
    out |= {"residue_contact_edge_density_8A": degree.sum() / 20, "residue_contact_mean_degree_8A": degree.mean(), "residue_contact_degree_std_8A": degree.std()}
    return out


def row_of(df):
    own = atoms.protein_atoms(df, "1", ["K"])
    return features.pocket_features(own, own.groupBy(*BY).agg((F.count_distinct("seq_id") / 6).alias("coverage")), BY).first().asDict()


def test_features_by_hand(spark):
    got, want = row_of(pocket(spark)), by_hand()
    assert tuple(got)[2:] == v.FEATURE_NAMES and len(v.FEATURE_NAMES) == 52 and set(want) == set(v.FEATURE_NAMES)
    for k in v.FEATURE_NAMES:
        assert got[k] == pytest.approx(want[k], abs=1e-8), k


def test_features_keep_under_motion_and_foreign_atoms(spark):
    turn = np.array([[0, 0, 1], [0, 1, 0], [-1, 0, 0]])  # boxes keep under quarter turns only
    foreign = ("T", "2", "M", None, "C9", "", "XYZ", "C", "HETATM", 1.0, 1.0, 400.0, -300.0, 200.0, 77)
    plain, moved, with_foreign = row_of(pocket(spark)), row_of(pocket(spark, turn, (11, -5, 90))), row_of(pocket(spark, more=(foreign,)))
    for k in v.FEATURE_NAMES:
        assert moved[k] == pytest.approx(plain[k], abs=1e-6) and with_foreign[k] == plain[k], k


def test_features_that_are_not_finite_fail(spark):
    bad = ("T", "1", "K", 3, "CD", "", "TRP", "C", "ATOM", 1.0, 1.0, float("nan"), 0.0, 0.0, 77)
    with pytest.raises(Exception, match="finite"):
        row_of(pocket(spark, more=(bad,)))


def test_features_scan_atoms_once(spark, tmp_path):
    pocket(spark).write.parquet(str(tmp_path / "a"))
    own = spark.read.parquet(str(tmp_path / "a"))
    out = features.pocket_features(own, spark.createDataFrame([("T", "K", 1.0)], "pdb_id string, asym_id string, coverage double"), BY)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(pdb_id") - plan.count("ReusedExchange") <= 6


def test_altloc_prefers_blank_then_occupancy_then_first(spark):
    base = ("T", "1", "A", 1, "CA")
    rows = [(*base, a, "ALA", "C", "ATOM", o, 1.0, 0.0, 0.0, 0.0, i) for i, (a, o) in enumerate((("B", 0.9), ("", 0.1), ("A", 0.9)))]
    rows += [("T", "1", "A", 2, "CA", a, "ALA", "C", "ATOM", 0.5, 1.0, 0.0, 0.0, 0.0, 10 + i) for i, a in enumerate(("C", "B", "B"))]
    got = {r.seq_id: r.ord for r in atoms.resolve_altlocs(spark.createDataFrame(rows, COLS), ["ord"]).collect()}
    assert got == {1: 1, 2: 11}


def test_least_foreign_distance_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    own = [(k % 5, *rng.uniform(-50, 50, 3).tolist()) for k in range(40)]
    other = [(k % 4, *rng.uniform(-300, 300, 3).tolist()) for k in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "p int, x double, y double, z double")
    for rounds in (0, 3, 12):
        got = {r.p: r for r in atoms.least_foreign_distance(frame(own), frame(other), ["p"], 5.0, rounds).collect()}
        for p in range(5):
            d = [np.linalg.norm(np.subtract(a[1:], b[1:])) for a in own if a[0] == p for b in other if b[0] == p]
            assert got[p].foreign == sum(b[0] == p for b in other) and got[p].unoccupied == (not d or min(d) >= 5.0)
            assert got[p].minimum == (pytest.approx(min(d)) if d else None)


def test_mean_plddt_leaves_out_what_is_not_finite(spark):
    rows = [("T", "1", "A", i, "CA", "", "ALA", "C", "ATOM", 1.0, b, 0.0, 0.0, 0.0, i) for i, b in enumerate((50.0, float("nan"), float("inf"), 70.0))]
    rows += [("U", "1", "A", 1, "CA", "", "ALA", "C", "ATOM", 1.0, float("inf"), 0.0, 0.0, 0.0, 9)]
    got = {r.pdb_id: r.mean_plddt for r in atoms.mean_plddt(spark.createDataFrame(rows, COLS), ["pdb_id"]).collect()}
    assert got["T"] == 60.0 and np.isnan(got["U"])


def test_ranks_of_any_key(spark):
    keys = [f"k{(i * 37) % 101:04d}" for i in range(101)]
    got = {r.k: r["rank"] for r in tables.global_rank(spark.createDataFrame([(k,) for k in keys], "k string"), "k", 7).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    with pytest.raises(ValueError):
        tables.batches(spark.range(3), "id", 0)


def test_sequence_windows(spark):
    row = spark.range(1).select(*(e.window_starts(F.lit(n), 10, 3).alias(str(n)) for n in (4, 10, 11, 24))).first()
    assert list(row) == [[0], [0], [0, 1], [0, 7, 14]]
def test_blank_row_only_for_empty_tables(spark):
    df = spark.createDataFrame([(1, "a")], "a int, b string")
    assert [tuple(r) for r in tables.or_blank(df).collect()] == [(1, "a")]
    assert [tuple(r) for r in tables.or_blank(df.where("a > 1")).collect()] == [(None, None)]


def test_bad_inputs_fail(spark):
    df = spark.createDataFrame([(";;",)], "s string")
    with pytest.raises(Exception):
        df.select(e.split_ids(F.col("s"))).collect()
    with pytest.raises(Exception):
        spark.createDataFrame([([0, 2],)], "p array<int>").select(e.inverse_permutation(F.col("p"))).collect()
    with pytest.raises(ValueError):
        e.window_starts(F.col("n"), 5, 5)


def test_windows(spark):
    df = spark.createDataFrame([(5,), (10,), (11,), (27,)], "n int")
    got = [r[0] for r in df.select(e.window_starts(F.col("n"), 10, 2)).collect()]
    assert got == [[0], [0], [0, 1], [0, 8, 16, 17]]
