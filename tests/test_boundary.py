import hashlib
import json
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.errors import ArtifactError, ContractError, EncoderError, LigandError, ProvenanceError, ServiceError, ViewError
from quernstone.operators import encoders, ligands, mapping, records, tables
from quernstone.sources import cif, files, remote


def test_digests_are_the_stated_ones():
    a = np.arange(6, dtype=np.float32).reshape(2, 3)
    assert files.array_sha256(a) == hashlib.sha256(b'{"dtype":"float32","shape":[2,3]}\0' + a.tobytes()).hexdigest()
    assert files.plain_array_sha256(a) == hashlib.sha256(b"float32[2,3]" + a.tobytes()).hexdigest()
    assert files.array_sha256(a.T) == files.array_sha256(np.ascontiguousarray(a.T))
    assert files.stable_json_bytes({"b": "é", "a": [1]}) == b'{\n  "a": [\n    1\n  ],\n  "b": "\\u00e9"\n}\n'


def test_write_once_looks_at_the_target_first(tmp_path):
    p = tmp_path / "x.bin"
    files.immutable_write(p, b"1")
    (tmp_path / ".x.bin.partial").write_bytes(b"?")
    files.immutable_write(p, b"1")
    with pytest.raises(ArtifactError, match="other bytes"):
        files.immutable_write(p, b"2")
    (tmp_path / ".y.bin.partial").write_bytes(b"?")
    with pytest.raises(ArtifactError, match="left over"):
        files.immutable_write(tmp_path / "y.bin", b"1")
    files.immutable_write(tmp_path / "m.json", files.stable_json_bytes({"t": "then"}))
    m = {"t": "now"}
    files.preserve_timestamp(tmp_path / "m.json", m, "t")
    assert m == {"t": "then"}
    with pytest.raises(ArtifactError):
        files.preserve_timestamp(tmp_path / "m.json", m, "u")


def test_tsv_keeps_tabs_quotes_and_line_feeds(spark, tmp_path):
    rows = [("1", 'a\tb "c"'), ("2", "x\ny"), ("3", ""), ("4", " z ")]
    df = spark.createDataFrame(rows, "k string, v string")
    text = files.tsv_bytes(df, ["k"])
    assert text.startswith(b'k\tv\n1\t"a\tb ""c"""\n2\t"x\ny"\n3\t\n')
    (tmp_path / "t.tsv").write_bytes(text)
    files.write_tsv(df, str(tmp_path / "folder"))
    for path in ("t.tsv", "folder"):
        assert sorted(tuple(r) for r in files.read_tsv(spark, str(tmp_path / path), None if path == "t.tsv" else ["k", "v"]).collect()) == rows
    with pytest.raises(ContractError):
        files.tsv_bytes(df.limit(0), ["k"])


def test_trees_go_by_the_parts_of_paths(spark, tmp_path):
    for name in ("a/b", "a.b", "a/__pycache__/c", "z"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(name.encode())
    ledger = files.file_ledger(spark, str(tmp_path / "t"))
    rows = [(r.path, r.sha256) for r in ledger.collect()]
    assert sorted(p for p, _ in rows) == ["a.b", "a/b", "z"]
    want = hashlib.sha256(b"".join(p.encode() + b"\0" + hashlib.sha256(p.encode()).digest() for p in ("a/b", "a.b", "z"))).hexdigest()
    assert files.tree_sha256(rows) == want == files.tree_digest(ledger).first().tree_sha256


def test_documents_of_json_and_yaml(tmp_path):
    (tmp_path / "a.json").write_text("[1]")
    (tmp_path / "a.yaml").write_text("schema_version: 2")
    with pytest.raises(ProvenanceError):
        files.load_json(tmp_path / "a.json")
    with pytest.raises(ContractError):
        files.load_yaml(tmp_path / "a.yaml")
    assert files.load_yaml(tmp_path / "a.yaml", 2) == {"schema_version": 2}


def test_damaged_structure_files_fail():
    import gzip

    with pytest.raises(ContractError, match="damaged"):
        cif.atom_rows(gzip.compress(b"data_x" * 100)[:-9])


def test_ledgers_fail_closed(spark):
    schema = "source_id string, path string, bytes long, sha256 string"
    seen = spark.createDataFrame([("a", 1, "ab"), ("b", 2, "cd")], "path string, bytes long, sha256 string")
    good = [("i", "a", 1, "AB"), ("j", "b", 2, "cd")]
    assert tables.verified(spark.createDataFrame(good, schema), seen).count() == 2
    for bad in ([], [("i", "a", None, "ab")], [("i", "a", 1, None)], [*good, ("i", "c", 1, "x")], [*good, ("k", "a", 1, "ab")], [(None, "a", 1, "ab")], [("i", "../a", 1, "ab")], [("i", "nowhere", 1, "ab")]):
        with pytest.raises(ProvenanceError):
            tables.verified(spark.createDataFrame(bad, schema), seen)


def test_views_are_unique(spark, tmp_path):
    schema = "series_id string, view string, status string"
    for name, rows in (("a", [("s", "S1", "eligible"), ("s", "S2", "no"), ("r", "S9", "eligible")]), ("b", [("q", "S3", "eligible")]), ("c", [("s", "S1", "eligible")])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"views": [dict(zip(("series_id", "view", "status"), r)) for r in rows]}, indent=1))
    paths = [str(tmp_path / f"{x}.json") for x in "abc"]
    assert [r.series_id for r in files.load_views(spark, paths[:2], schema).collect()] == ["q", "s"]
    with pytest.raises(ContractError):
        files.load_views(spark, paths, schema)


def test_constructs(spark, tmp_path):
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    frame = lambda *rows: spark.createDataFrame(rows, "group_id string, construct_sha256 string, sequence string")
    assert files.constructs(frame(("b", digest("MK"), "MK"), ("a", digest("MV"), "MV"), ("b", digest("MK"), "MK"))).collect()[0].group_id == "a"
    for bad, say in (((("b", digest("MK"), "MK"), ("b", digest("MV"), "MV")), "inconsistent"), ((("b", digest("MV"), "MK"),), "digest"), ((("b", digest("mk"), "mk"),), "canonical")):
        with pytest.raises(Exception, match=say):
            files.constructs(frame(*bad)).collect()
    head = "role\tconstruct_group_id\tconstruct_sha256\tconstruct_sequence\tpKd\tvalue_nm\n"
    (tmp_path / "p.tsv").write_text(head + "supervised_s0\tg\th\tMK\t5\t\n")
    with pytest.raises(ContractError, match="reference"):
        files.read_constructs(spark, str(tmp_path / "p.tsv"))
    (tmp_path / "q.tsv").write_text(head + "site_reference_only\tg\th\tMK\t0\t\nsupervised_s0\tg\th\tMK\t5\t\n")
    with pytest.raises(ContractError, match="label"):
        files.read_constructs(spark, str(tmp_path / "q.tsv"))


class Service:
    def __init__(self, *answers):
        self.answers, self.calls, self.waits = list(answers), [], []

    def __call__(self, method, url, body, headers, timeout):
        self.calls.append((method, url, body, timeout))
        x = self.answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x


def test_services(tmp_path):
    ok = Service(OSError("gone"), (500, b""), (200, b"no json"), (200, b'{"data": 1}'))
    assert remote.post_json("u", {"q": 1}, transport=ok, wait=ok.waits.append) == {"data": 1}
    assert ok.waits == [1, 2, 4] and ok.calls[0] == ("POST", "u", b'{"q":1}', 120.0)
    for answers, calls in (((200, b'{"errors": [1]}'),), 1), (((200, b"[]"),), 1), ((OSError(),) * 4, 4):
        s = Service(*answers)
        with pytest.raises(ServiceError):
            remote.post_json("u", {}, transport=s, wait=s.waits.append)
        assert len(s.calls) == calls
    for answer in ((204, b""), (200, b"")):
        assert remote.post_search("u", {}, transport=Service(answer)) == {"total_count": 0, "result_set": []}
    s = Service(*(OSError(),) * 5)
    with pytest.raises(ServiceError):
        remote.post_search("u", {}, transport=s, wait=s.waits.append)
    assert s.waits == [1, 2, 4, 8]
    s = Service((200, b"x"))
    assert remote.get_once(tmp_path / "f", "u", s) == remote.get_once(tmp_path / "f", "u", s) == b"x" and s.calls[0][3] == 180.0
    with pytest.raises(ServiceError):
        remote.get("u", Service((404, b"")))
    seen = []
    landed = remote.acquire(["b", "a", "b"], tmp_path / "s", lambda n: seen.append(n) or {"n": n})
    assert seen == ["a", "b"] == [x["name"] for x in landed] and remote.acquire(["a"], tmp_path / "s", None) == landed[:1]
    terms = remote.search_payload("P1")["query"]["nodes"]
    assert [t["parameters"]["value"] for t in terms] == ["P1", "UniProt", "X-RAY DIFFRACTION", 0]


def test_search_request_quotes(spark):
    row = spark.createDataFrame([('P"\\1',)], "a string").select(remote.search_request(F.col("a"))).first()
    assert json.loads(row[0]) == remote.search_payload('P"\\1')


def test_incomplete_answers_fail(spark):
    found = spark.createDataFrame([("P", 3, '["1ab", {"identifier": "2CD"}, "1AB"]'), ("Q", None, None)], "accession string, total_count int, result_set string")
    with pytest.raises(Exception, match="incomplete search: P"):
        records.searched(found).collect()
    good = records.searched(found.withColumn("total_count", F.col("total_count") - 1))
    assert {r.accession: r.identifiers for r in good.collect()} == {"P": ["1AB", "2CD"], "Q": []}
    entries = spark.createDataFrame([("1ab",)], "rcsb_id string")
    with pytest.raises(ContractError, match="2CD"):
        records.entries_of(good, entries)
    entry = lambda n: spark.createDataFrame([(json.dumps({"rcsb_id": "X", "nonpolymer_entities": n}),)], "e string")
    one = lambda n: records.without_nonpolymers(records.parsed(entry(n), "e", records.ENTRY).withColumnRenamed("e", "entry")).count()
    assert one(None) == one([]) == 1
    with pytest.raises(Exception, match="nonpolymer"):
        one([{"rcsb_id": "L"}])
    answers = spark.createDataFrame([("P", [("P", True, None, 1, "", "e", "", "MK", None)])], f"accession string, records array<struct<{records.PREDICTION.replace(' ', ':').replace(',:', ',')}>>")
    with pytest.raises(Exception, match="incomplete record"):
        records.predictions(spark.createDataFrame([("P",)], "accession string"), answers).collect()


def test_scatter_add_refuses_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 3.0), (1, 5.0)], "i long, x double")
    assert [r.value for r in tables.scatter_add(df, "i", "x", 3).orderBy("index").collect()] == [3.0, 6.0, 0.0]
    assert tables.scatter_add(df, "i", "x").count() == 2
    for bad in (df.limit(3).withColumn("i", F.col("i") - 1), df.withColumn("i", F.when(F.col("i") > 0, F.col("i")))):
        with pytest.raises(ContractError):
            tables.scatter_add(bad, "i", "x", 3)
    with pytest.raises(ContractError):
        tables.scatter_add(df, "i", "x", 1)


def test_pooled_vector(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0])], "k string, v array<double>")
    assert tables.pooled_vector(df, ["k"], "v").first().pooled == [2.0, 4.0, 1.0, 2.0]


def _describer():
    """A toy describer: letters are atoms in a chain; the canonical text is the smaller one of a text and its reverse."""

    def describe(text):
        order = list(range(len(text))) if text <= text[::-1] else list(range(len(text)))[::-1]
        return {
            "canonical_smiles": min(text, text[::-1]),
            "output_order": str(order),
            "atoms": [{"index": i, "atomic_number": ord(x), "charge": 0, "isotope": 0, "aromatic": x.islower()} for i, x in enumerate(text)],
            "bonds": [{"first": i, "last": i + 1, "type": "SINGLE"} for i in range(len(text) - 1)],
        }

    return describe


def test_canonical_mapping_by_an_injected_describer(spark):
    df = spark.createDataFrame([(1, "OCC", "CCO"), (2, "CCO", "CCO"), (3, "C", "C")], "molecule_id long, smiles string, canonical_smiles string")
    got = {r.molecule_id: (r.status, r.canonical_to_input, r.input_to_canonical) for r in ligands.canonical_mapping(df, _describer()).collect()}
    assert got == {1: ("mapped", [2, 1, 0], [2, 1, 0]), 2: ("mapped", [0, 1, 2], [0, 1, 2]), 3: ("mapped", [0], [0])}
    with pytest.raises(Exception, match="differs"):
        ligands.canonical_mapping(spark.createDataFrame([(1, "OCC", "OCC")], df.schema), _describer()).collect()


def test_strict_ligands(spark):
    df = spark.createDataFrame([("CCO",), ("C[0CH2:0]",)], "s string")
    assert ligands.strict(df, "s").count() == 2
    for bad in ("C |x|", "[CH3:12]", "[13C]", "[2H]O"):
        with pytest.raises(Exception, match="refused"):
            ligands.strict(spark.createDataFrame([(bad,)], "s string"), "s").collect()
    assert ligands.strict(spark.createDataFrame([("[13C]",)], "s string"), "s", isotopes=False).count() == 1
    with pytest.raises(Exception, match="contract"):
        one = spark.createDataFrame([(1, [1.0])], "k int, vector array<double>")
        ligands.released_vector(one, one, "k", [0.0], [1.0], 1.0).collect()
    with pytest.raises(Exception, match="different molecules"):
        both = [spark.createDataFrame([(1, c, [1.0])], "k int, canonical_smiles string, vector array<double>") for c in ("C", "O")]
        ligands.compared(*both, "k", lambda a, b: {"same": a == b}).collect()


def test_encoders_check_what_they_get(spark):
    df = spark.createDataFrame([("a", "ACDEFGHIKL")], "k string, sequence string")
    good = encoders.encode_sequences(df, "k", lambda: lambda t: np.ones((len(t), 3)), 3, 4, 1).first()
    assert good.vector == [1.0, 1.0, 1.0]
    for bad in (lambda t: np.ones((len(t) + 1, 3)), lambda t: np.full((len(t), 3), np.nan)):
        with pytest.raises(Exception, match="states"):
            encoders.encode_sequences(df, "k", lambda bad=bad: bad, 3, 4, 1).collect()
    encoders.require_identity({"revision": "r", "dim": 3}, {"revision": "r", "dim": 3, "more": 1})
    for seen in ({"revision": "r"}, {"revision": "s", "dim": 3}):
        with pytest.raises(EncoderError):
            encoders.require_identity({"revision": "r", "dim": 3}, seen)


def test_sources_of_models(tmp_path):
    (tmp_path / "m.py").write_text("value = 7")
    assert encoders.load_plugin(tmp_path, "m.py", "quernstone_test_plugin").value == 7
    assert encoders.load_plugin(tmp_path, "m.py", "quernstone_test_plugin").value == 7
    for bad in (("../x.py", "q2"), ("none.py", "q3"), ("m.py", "json")):
        with pytest.raises(EncoderError):
            encoders.load_plugin(tmp_path, *bad)
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "m.py")
    run("commit", "-qm", "x")
    revision, dirty = encoders.source_revision(tmp_path, ("m.py",))
    assert len(revision) == 40 and not dirty
    (tmp_path / "m.py").write_text("value = 8")
    assert encoders.source_revision(tmp_path, ("m.py",))[1]
    with pytest.raises(EncoderError):
        encoders.source_revision(tmp_path / "none")


def test_aligner_process(spark, tmp_path):
    script = tmp_path / "align.py"
    script.write_text("import sys\nprint('#PDB1\\n' + '\\t'.join([sys.argv[1], sys.argv[2], '0.5', '0.75', '2.5', '1', '1', '1', '10', '20', '8']))")
    call = lambda left, right, mode: [sys.executable, str(script), left, right]
    jobs = spark.createDataFrame([("a", "b", "sequential")], "left_path string, right_path string, mode string")
    (r,) = encoders.run_aligner(jobs, call).collect()
    assert (r.tm_1, r.tm_2, r.rmsd, r.length_1, r.length_2, r.aligned, r.fields) == (0.5, 0.75, 2.5, 10, 20, 8, 11) and len(r.stdout_sha256) == 64
    with pytest.raises(Exception, match="aligner failed"):
        encoders.run_aligner(jobs, lambda *_: [sys.executable, "-c", "raise SystemExit(3)"]).collect()
    with pytest.raises(Exception, match="no row"):
        encoders.aligner_row(spark.createDataFrame([("#x\n",)], "stdout string")).collect()
    with pytest.raises(Exception, match="unexpected"):
        encoders.aligner_row(spark.createDataFrame([("a b c",)], "stdout string")).collect()


def test_record_types(spark):
    from quernstone.functions import schemas

    df = spark.createDataFrame([("x", "s", "1", "a", "z")], "path string, sha256 string, bytes string, source_id string, more string")
    out = schemas.conform(df, schemas.FILE)
    assert out.schema.simpleString() == schemas.FILE.simpleString() and out.first() == ("a", "x", 1, "s")
    with pytest.raises(ContractError):
        schemas.conform(df.drop("path"), schemas.FILE)
    assert schemas.conform(df.drop("path"), schemas.FILE, ("path",)).first().path is None
    with pytest.raises(Exception, match="x1"):
        schemas.conform(df.withColumn("bytes", F.lit("x1")), schemas.FILE).collect()


def test_mapped_sites(spark):
    df = spark.createDataFrame([([1, 2, 9], {1: 2, 2: 3}, "AC", "XAD")], "positions array<int>, pairs map<int,int>, construct_sequence string, sequence string").withColumn("alignment", F.struct("pairs"))
    r = mapping.with_site(df).first()
    assert r.site_map == {1: 2, 2: 3} and r.site_coverage == pytest.approx(2 / 3) and r.site_identity == 0.5


def test_predicted_views(spark):
    from quernstone.plans import builds
    from tests.test_builds import pilot, structure
    from tests.test_features import COLS

    fixed = spark.createDataFrame(structure("R", ligand=3.0) + structure("Q", "B") + structure("W", ligand=9.0), COLS)
    rows = pilot(spark).withColumn("construct_sequence", F.lit("AGSY"))
    views, sites = builds.pocket_views(rows, fixed)
    _, expected = builds.site_definitions(builds.reference_rows(rows, "ord"), fixed)
    ca = lambda pdb, b=80.0, n=6: [(pdb, "1", "A", i, "CA", "", x, "C", "ATOM", 1.0, b, float(i), 0.0, 0.0, i) for i, x in enumerate(("MET", "ALA", "GLY", "SER", "TYR", "LYS")[:n], 1)]
    record = spark.createDataFrame([("P1", "AF1", "MAGSYK", "h1")], "uniprot_accession string, entry_id string, sequence string, cif_sha256 string")

    def build(predicted, record=record, plddt=70.0, identity=0.9):
        return builds.predicted_views(rows, sites, expected, fixed.unionByName(ca_fixed), record, spark.createDataFrame(predicted, COLS), views, 0.9, identity, 0.8, 0.9, plddt)

    ca_fixed = spark.createDataFrame([("R", "1", "A", i, "CA", "", x, "C", "ATOM", 1.0, 1.0, float(i), 0.5, 0.0, 50 + i) for i, x in enumerate(("ALA", "GLY", "SER", "TYR"), 1)], COLS)
    told, s2, texts = build(ca("AF1"))
    assert {(r.view, r.status) for r in told.collect()} == {("S1", "eligible"), ("S2", "eligible")}
    got = {r.view_id: r for r in s2.collect()}
    assert sorted(got) == ["o1:S2", "o2:S2"] and got["o1:S2"].pocket_positions_label_seq_id == "2;3;4;5" and got["o1:S2"].pocket_atom_count == 4 and got["o1:S2"].feature_structure_pdb_id == "AF1"
    assert {(r.view, r.region): r.ca_count for r in texts.collect()} == {("S1", "global"): 4, ("S1", "pocket"): 4, ("S2", "global"): 6, ("S2", "pocket"): 4}
    assert builds.view_counts(told) == {"S1:eligible": 1, "S2:eligible": 1}
    with pytest.raises(ViewError):
        build(ca("AF1"), plddt=90.0)
    counts = builds.pocket_counts(views, sites)
    assert counts == {"S0_views": 2, "S1_views": 2, "supervised_observations": 2, "site_definitions": 1}
    m = builds.manifest("pockets", counts, {"pilot": "h"}, {"views": files.tsv_bytes(views, ["view_id"])}, {"cutoff": 6.0}, "now")
    assert files.stable_json_bytes(m) == files.stable_json_bytes(m) and m["outputs"]["views"]["bytes"] > 0
    assert issubclass(LigandError, RuntimeError)
