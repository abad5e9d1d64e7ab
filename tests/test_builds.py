import pytest
from pyspark.sql import functions as F

from quernstone.errors import ContractError
from quernstone.functions.vocab import FEATURE_NAMES
from quernstone.plans import builds
from tests.test_features import COLS

PILOT = "role string, construct_group_id string, construct_sha256 string, observation_id string, pdb_id string, protein_entity_id string, protein_asym_ids string, ligand_entity_id string, ligand_asym_ids string, ligand_comp_id string, uniprot_accession string, inchikey string, canonical_smiles string, pKd string, value_nm string, ord long"


def structure(pdb, asym="A", last=4, ligand=None, names=("ALA", "GLY", "SER", "TYR")):
    rows = [(pdb, "1", asym, i, a, "", names[i - 1], a, "ATOM", 1.0, 50.0, float(i), y, 0.0, i) for i in range(1, last + 1) for a, y in (("C", 0.0), ("N", 1.0))]
    return rows + ([(pdb, "2", "L", None, "C1", "", "LIG", "C", "HETATM", 1.0, 1.0, 2.5, ligand, 0.0, 99)] if ligand else [])


def pilot(spark, label="", query="Q"):
    row = lambda role, obs, pdb, pkd, n: (role, "g", "h", obs, pdb, "1", "A;B", "2", "L", "LIG", "P1", "k", "C", pkd, "", n)
    return spark.createDataFrame([row("site_reference_only", "r", "R", label, 0), row("supervised_s0", "o1", query, "5", 1), row("supervised_s0", "o2", "W", "6", 2)], PILOT)


def test_pocket_views(spark):
    atoms = spark.createDataFrame(structure("R", ligand=3.0) + structure("Q", "B") + structure("W", ligand=9.0), COLS)
    views, sites = builds.pocket_views(pilot(spark), atoms)
    got = {r.view_id: r for r in views.collect()}
    assert sorted(got) == ["o1:S0", "o1:S1", "o2:S0", "o2:S1"] and sites.first().positions == [1, 2, 3, 4]
    assert [got[f"o1:{t}"].feature_protein_asym_id for t in ("S0", "S1")] == ["B", "A"] and got["o1:S1"].feature_structure_pdb_id == "R"
    for r in got.values():  # all structures have the same shape
        assert [r[n] for n in FEATURE_NAMES] == pytest.approx([got["o1:S0"][n] for n in FEATURE_NAMES], abs=1e-9)
        assert r.missing_positions_label_seq_id == "" and r.pocket_positions_label_seq_id == "1;2;3;4"


def test_pocket_views_fail_closed(spark):
    good = structure("R", ligand=3.0) + structure("Q")
    frame = lambda rows: spark.createDataFrame(rows, COLS)
    with pytest.raises(ContractError, match="labels"):
        builds.pocket_views(pilot(spark, label="0"), frame(good + structure("W")))
    with pytest.raises(ContractError, match="among the supervised"):
        builds.pocket_views(pilot(spark, query="R"), frame(good + structure("W")))
    with pytest.raises(ContractError, match="coverage"):
        builds.pocket_views(pilot(spark), frame(good + structure("W", last=3)))
    with pytest.raises(ContractError, match="mismatch"):
        builds.pocket_views(pilot(spark), frame(good + structure("W", names=("ALA", "GLY", "SER", "TRP"))))


def test_structure_edges(spark):
    views = spark.createDataFrame([("a", "S1", "eligible"), ("b", "S1", "eligible"), ("c", "S1", "mapping"), ("a", "S2", "eligible")], "construct_group_id string, view string, status string")
    figures = "left_construct_group_id string, right_construct_group_id string, view string, region string, mode string, tm_1 double, tm_2 double, length_1 int, length_2 int, aligned int, rmsd double"
    measured = spark.createDataFrame([("a", "b", "S1", "global", "sequential", 0.4, 0.7, 100, 60, 40, 9.0), ("a", "b", "S1", "pocket", "sequential", 0.8, 0.7, 10, 10, 10, 4.5)], figures)
    pairs, edges = builds.structure_edges(views, measured, ["sequential"], (0.5, 30, 0.6), (0.5, 8, 0.6, 4.0))
    assert {(r.region, r.edge) for r in pairs.collect()} == {("global", True), ("pocket", False)}
    (r,) = edges.collect()
    assert (r.evidence, r.regions, r.best_tm, r.best_aligned) == (1, "global", 0.7, 40)
    with pytest.raises(Exception, match="no measurement"):
        builds.structure_edges(views, measured.limit(1), ["sequential"], (0.5, 30, 0.6), (0.5, 8, 0.6, 4.0))[0].collect()


def test_unoccupied_views(spark):
    atoms = spark.createDataFrame(structure("H", ligand=3.0) + structure("E") + structure("F"), COLS)
    expected = spark.createDataFrame([("g", i, n) for i, n in enumerate(("ALA", "GLY", "SER", "TYR"), 1)], "pdb_id string, seq_id int, expected_name string")
    cand = spark.createDataFrame([("g", "H", "1", ["A"], 1.0, ""), ("g", "E", "1", ["Z", "A"], 2.0, ""), ("g", "F", "1", ["A"], 2.0, "2001-01-01"), ("g", "X", "1", ["A"], 3.0, "")], "construct_group_id string, pdb_id string, entity_id string, asym_ids array<string>, resolution double, release_date string")
    selected, attempts = builds.unoccupied_views(cand, atoms, expected, 8.0)
    assert [r.pdb_id for r in selected.collect()] == ["F"]
    assert sorted((r.pdb_id, r.ok) for r in attempts.collect()) == [("F", True), ("H", False)]
    late = cand.where(F.col("pdb_id") != "F")
    selected, attempts = builds.unoccupied_views(late, atoms, expected, 8.0)
    assert [(r.pdb_id, r.asym_id) for r in selected.collect()] == [("E", "A")] and attempts.count() == 3


def test_structure_pairs_are_not_shuffled_and_each_job_counts(spark, monkeypatch):
    groups = [("v", g) for g in "abcde"] + [("w", g) for g in "ab"] + [("x", "a")]
    views = spark.createDataFrame([(g, v, "eligible") for v, g in groups], "construct_group_id string, view string, status string")
    names = ["left_construct_group_id", "right_construct_group_id", "view", "region", "mode"]
    options = [("global", "sequential"), ("pocket", "sequential"), ("pocket", "fully_nonsequential")]
    jobs = [(a, b, v, *o) for v, a in groups for u, b in groups if u == v and a < b for o in options]
    gates = ["sequential", "fully_nonsequential"], (0.5, 30, 0.6), (0.5, 8, 0.6, 4.0)

    def pairs(rows):
        x = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
        lit = {"tm_1": 0.4, "tm_2": 0.7, "length_1": 100, "length_2": 60, "aligned": 40, "rmsd": 1.0}
        return builds.structure_edges(views, x.withColumns({k: F.lit(v) for k, v in lit.items()}), *gates)[0]

    strangers = [("b", "a", "v", *options[0]), ("a", "z", "v", *options[0]), ("a", "b", "x", *options[0]), ("a", "b", "v", "global", "fully_nonsequential"), (None, "b", "v", *options[0])]
    for most in (1 << 21, 0):
        monkeypatch.setattr(builds.tables, "GROUPS_SENT", most, raising=False)
        out = pairs(jobs + strangers)
        assert sorted(tuple(r[n] for n in names) for r in out.collect()) == sorted(jobs)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 0 or not most
    assert sorted(tuple(r[n] for n in names) for r in pairs(jobs + jobs[:2]).collect()) == sorted(jobs + jobs[:2])
    for lost in (jobs[0], jobs[-1]):
        rest = [j for j in jobs if j != lost]
        with pytest.raises(Exception, match="no measurement"):
            pairs(rest).collect()
        with pytest.raises(Exception, match="no measurement"):
            pairs(rest + rest[3:4]).collect()


def test_structure_edges_are_not_written_before_they_are_asked_for(spark, monkeypatch):
    written, landed = [], builds.tables.landed
    monkeypatch.setattr(builds.tables, "landed", lambda df: written.append(df.columns) or landed(df))
    views = spark.createDataFrame([("a", "S1", "eligible"), ("b", "S1", "eligible")], "construct_group_id string, view string, status string")
    measured = spark.sql("select 'a' left_construct_group_id, 'b' right_construct_group_id, 'S1' view, r region, 'sequential' mode, 0.4d tm_1, t tm_2, 10 length_1, 10 length_2, 9 aligned, 1d rmsd from values ('global', 0.7d), ('pocket', 0.1d) v(r, t)")
    for least, evidence in ((0.5, 1), (0.9, None)):
        edges = builds.structure_edges(views, measured, ["sequential"], (least, 8, 0.6), (0.5, 8, 0.6, 4.0))[1]
        assert [r.evidence for r in edges.collect()] == [evidence]
    assert all("evidence" not in names for names in written)
