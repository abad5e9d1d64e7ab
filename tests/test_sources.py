import gzip

import numpy as np
import pytest

from quernstone.errors import ContractError, ProvenanceError, mandatory, require_unique
from quernstone.operators.align import local_alignment
from quernstone.sources import cif, files

CIF = """data_x
_entry.id x
loop_
_atom_site.group_PDB
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_entity_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.B_iso_or_equiv
_atom_site.auth_seq_id
_atom_site.auth_asym_id
_atom_site.pdbx_PDB_model_num
ATOM c CA . ala A 1 1 1.0 2.0 3.0 . ? 1 A 1
HETATM C "C1'" A lig B 2 . 1.5 2.0 3.0 0.5 7.0 1 B 1
ATOM C CA . ALA A 1 1 9.0 9.0 9.0 1.0 7.0 1 A 2
#
"""


def test_cif_plain_and_gzip(spark, tmp_path):
    (tmp_path / "a.cif").write_text(CIF)
    (tmp_path / "b.cif.gz").write_bytes(gzip.compress(CIF.encode()))
    for name in ("a.cif", "b.cif.gz"):
        r = cif.read_atoms(spark, str(tmp_path / name)).orderBy("ord").collect()
        assert len(r) == 2 and r[0].element == "C" and r[0].residue_name == "ALA" and r[0].occupancy == 1.0 and np.isnan(r[0].b_factor)
        assert r[1].atom_name == "C1'" and r[1].alt_id == "A" and r[1].seq_id is None


def test_cif_without_atoms_fails():
    with pytest.raises(ContractError):
        cif.atom_rows(b"data_x\n_entry.id x\n")


def test_write_once(tmp_path):
    p = tmp_path / "x.json"
    files.immutable_write(p, files.stable_json_bytes({"b": 1, "a": 2}))
    files.immutable_write(p, files.stable_json_bytes({"a": 2, "b": 1}))
    with pytest.raises(ProvenanceError):
        files.immutable_write(p, b"other")
    with pytest.raises(ValueError):
        files.stable_json_bytes({"x": float("nan")})


def test_array_digests_differ():
    a = np.arange(4, dtype=np.float32)
    assert files.array_sha256(a) != files.plain_array_sha256(a)


def test_tsv(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\t\nx\ty\n")
    df = files.read_tsv(spark, str(tmp_path / "t.tsv"))
    assert sorted(tuple(r) for r in df.collect()) == [("1", ""), ("x", "y")]
    assert files.tsv_bytes(df, ["a"]) == b"a\tb\n1\t\nx\ty\n"


def test_contracts(spark):
    df = spark.createDataFrame([(1,), (1,)], "a int")
    with pytest.raises(ContractError):
        require_unique(df, "a")
    with pytest.raises(Exception, match="no partner"):
        mandatory(df, spark.createDataFrame([(2, 3)], "a int, b int"), ["a"], "no partner").collect()


def test_alignment():
    r = local_alignment("XXACGT", "ACGTYY")
    assert r["score"] == 8.0 and r["pairs"] == {3: 1, 4: 2, 5: 3, 6: 4} and r["identity"] == 1.0
