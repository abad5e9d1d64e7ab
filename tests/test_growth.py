"""Plans and rows of queries that grow with their tables."""

import glob
import os
import re
import time

import pytest

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@here
def test_ligand_mappings_broadcast_no_side(spark):
    from quernstone.plans.catalogue import QUERIES

    plan = final_plan(QUERIES["ligand_mappings"](spark, DATA))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_pairs_come_from_one_of_the_parts_they_share():
    import numpy as np
    import pyarrow as pa

    from quernstone.llm import jaccard

    bits = jaccard.narrow(np.arange(100, dtype=np.uint64))
    parts, nodes = list(range(10, 30)), list(range(1, 7))

    def batch(part):
        low = parts[: jaccard.NAMED]
        rows = {"part": [part] * 6, "node": nodes, "label": nodes, "n": [100] * 6, "bits": [bits] * 6, "low": [low] * 6}
        return pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) if k == "bits" else pa.array(v, pa.list_(pa.int64()) if k == "low" else pa.int64()) for k, v in rows.items()], list(rows))

    out = [b for b in jaccard._compare(80, None, rows=1)(map(batch, parts))]
    pairs = [p for b in out for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sorted(pairs) == [(a, b) for a in nodes for b in nodes if a > b]


def test_a_landed_table_leaves_no_shuffle_files(spark):
    from quernstone.sources.files import landed

    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    count = lambda: len(glob.glob(f"{root}/**/shuffle_*.data", recursive=True))
    before = count()
    kept = landed(spark.range(10_000).repartition(7, "id"))
    for _ in range(50):
        if count() <= before:
            break
        time.sleep(0.1)
    assert count() <= before and kept.count() == 10_000


def test_wide_cells_send_an_atom_to_few_cells_and_lose_no_pair(spark):
    import numpy as np

    from quernstone.operators import atoms

    rng = np.random.default_rng(3)
    left = spark.createDataFrame([(1, *x) for x in rng.uniform(-20, 20, (300, 3)).tolist()] + [(1, 0.0, 0.0, 0.0)], "p int, x double, y double, z double")
    right = spark.createDataFrame([(1, *x) for x in rng.uniform(-20, 20, (300, 3)).tolist()] + [(1, 2.0, 0.0, 0.0), (1, -2.0, 0.0, 0.0), (1, 0.0, 2.0, 0.0)], "p int, rx double, ry double, rz double")
    found = [{tuple(r) for r in atoms.near(left, right, ["p"], 2.0, sides).collect()} for sides in (1, 8)]
    pairs = left.join(right, "p").where("sqrt((x-rx)*(x-rx)+(y-ry)*(y-ry)+(z-rz)*(z-rz)) <= 2").count()
    assert found[0] == found[1] and len(found[0]) == pairs >= 3


def test_pairs_of_one_view_come_from_many_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quernstone.operators import tables

    monkeypatch.setattr(tables, "PAIR_BLOCK", 7, raising=False)
    groups = spark.createDataFrame([(i, "v") for i in range(50)] + [(3, "v"), (3, "w"), (9, "w"), (None, "w"), (5, None)], "g int, view string")
    pairs = tables.all_pairs(groups, "g", "view")
    rows = groups.collect()
    want = sorted((x.g, y.g, x.view) for x in rows for y in rows if None not in (x.g, y.g, x.view) and x.view == y.view and x.g < y.g)
    assert sorted((r.left_g, r.right_g, r.view) for r in pairs.collect()) == want
    assert pairs.where("view = 'v'").select(F.spark_partition_id()).distinct().count() > 1
    counts = {(r.left_g, r.right_g, r.view): r.n for r in tables.pair_counts(groups, "g", "view", 3).collect()}
    assert counts == {k: 3 * want.count(k) for k in set(want)}


def test_components_take_one_table_for_a_small_graph_and_rounds_for_a_large_one(spark, monkeypatch):
    import random

    from quernstone.llm import _common, graph

    rng = random.Random(5)
    chain = [(i + 1, i) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(-5, 2000), (2000, -9)]
    rng.shuffle(chain)
    want = {x: 0 for x in range(301)} | {1000 + i: 1000 for i in range(50)} | {-5: -9, 2000: -9, -9: -9}
    edges = _common.settle(spark.createDataFrame(chain, "a long, b long").repartition(8))
    tables, settle = [], _common.settle
    monkeypatch.setattr(_common, "settle", lambda df, *a: tables.append(1) or settle(df, *a))
    for most, few in ((1 << 20, True), (60, False)):
        monkeypatch.setattr(graph, "TASK_EDGES", most, raising=False)
        tables.clear()
        assert {r.node: r.label for r in graph.components(edges).collect()} == want
        assert (len(tables) == 1) == few


def test_ordered_pairs_come_in_order_without_a_sort_of_pairs(spark, monkeypatch):
    from quernstone.operators import tables

    groups = spark.createDataFrame([(i * 7 % 41, "v") for i in range(41)] + [(3, "v"), (3, "u"), (9, "u"), (20, "u"), (None, "u"), (5, None)], "g int, view string").repartition(3)
    modes = ["sequential", "fully_nonsequential"]
    want = sorted(tuple(r) for r in tables.with_modes(tables.all_pairs(groups, "g", "view"), modes).select("left_g", "right_g", "view", "region", "mode").collect())
    for most, sends in ((1 << 20, True), (0, False)):
        monkeypatch.setattr(tables, "MEMBERS_SENT", most)
        out = tables.ordered_pairs(groups, "g", "view", modes)
        assert [tuple(r) for r in out.collect()] == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("rangepartitioning(left_g" in plan and "rangepartitioning(left_g, right_g" not in re.sub(r"#\d+L?| ASC NULLS FIRST", "", plan)) == sends


@here
def test_edge_rollup_shuffles_no_pair(spark):
    from quernstone.plans.catalogue import QUERIES

    plan = final_plan(QUERIES["edge_rollup"](spark, DATA.replace("0.001", "0.01")))  # the smallest has no edges
    assert "SortMergeJoin" in plan and "hashpartitioning(left_" not in plan


def test_pairs_rolled_up_where_they_arise_equal_the_rollup_of_their_evidence(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quernstone.operators import tables
    from quernstone.plans import catalogue

    monkeypatch.setattr(tables, "PAIR_BLOCK", 7)
    rows = [(i, i % 4, i % 90 + 10) for i in range(40)] + [(i, v, i % 90 + 10) for i in range(20, 60) for v in (1, 7, 10)] + [(i, 7, 11 + i % 3) for i in range(30, 50)] * 2 + [(None, 1, 10), (3, None, 10)]
    groups = spark.createDataFrame(rows, "g long, view int, len long")
    jobs = tables.with_modes(tables.all_pairs(groups, "g", "view"), catalogue._MODES)
    evidence = jobs.select("left_g", "right_g", F.col("view").cast("string").alias("view"), "region", "mode", *(c.alias(n) for n, c in catalogue._job(F.col).items() if n in ("edge", "max_tm", "rmsd")))
    want = sorted(tuple(r) for r in tables.edge_rollup(evidence.where("edge"), ["left_g", "right_g"]).collect())
    assert {";" in r[3] for r in want} == {";" in r[5] for r in want} == {True, False}
    for most, shuffled in ((64, False), (3, True)):
        monkeypatch.setattr(tables, "ROWS_CARRIED", most, raising=False)
        out = tables.rolled_pairs(groups, "g", "view", catalogue._MODES, catalogue._job)
        assert sorted(tuple(r) for r in out.collect()) == want
        assert ("hashpartitioning(left_" in final_plan(out)) == shuffled
