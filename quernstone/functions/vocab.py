"""Fixed values of the data model."""

#: One-letter codes in order; X is any other residue.
AA_ORDER = tuple("ACDEFGHIKLMNPQRSTVWYX")
#: Residue names and their one-letter codes.
AA3_TO_1 = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
    "MSE": "M", "SEC": "C", "PYL": "K",
}
AA1_TO_3 = {v: k for k, v in AA3_TO_1.items() if k not in ("MSE", "SEC", "PYL")}
ELEMENT_ORDER = ("C", "N", "O", "S", "P", "SE", "OTHER")
PAIR_BINS = (0.0, 4.0, 6.0, 8.0, 10.0, 12.0, 16.0, 20.0, 30.0, float("inf"))
HYDROGENS = ("H", "D")
WATERS = ("HOH", "DOD", "WAT")
CONTACT_CUTOFF = 6.0
GRAPH_CUTOFF = 8.0
MINIMUM_RESIDUES = 4
MINIMUM_COVERAGE = 0.8
RESOLUTION_CAP = 2.8
#: Scores of the local aligner: match, mismatch, first gap, further gaps.
ALIGN_SCORES = (2.0, -1.0, -5.0, -0.5)
#: The columns of an mmCIF atom table that a scan keeps.
ATOM_TAGS = (
    "group_PDB", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_entity_id", "label_seq_id",
    "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv", "auth_asym_id", "auth_seq_id", "pdbx_PDB_model_num",
)
FEATURE_NAMES = (
    "pocket_residue_count", "pocket_atom_count", "pocket_position_coverage", "pocket_missing_fraction",
    *(f"aa_fraction_{a}" for a in AA_ORDER), *(f"element_fraction_{e}" for e in ELEMENT_ORDER),
    "coord_radius_of_gyration", "coord_max_radius", "bbox_extent_large", "bbox_extent_mid", "bbox_extent_small",
    "coord_std_large", "coord_std_mid", "coord_std_small", *(f"residue_pair_distance_bin_{i}" for i in range(9)),
    "residue_contact_edge_density_8A", "residue_contact_mean_degree_8A", "residue_contact_degree_std_8A",
)
