"""Ranked picks, rollups, ledgers and waterfalls on plain tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ContractError, ProvenanceError
from ..sources.files import landed


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_wins(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, "r.*")


def last_wins(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, "r.*")


def attempts(df: DataFrame, by: list[str], order: list[Column], ok: str) -> DataFrame:
    """Every row up to and including the first success of its group."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__ok", F.coalesce(F.max(ok).over(before), F.lit(False))).where(~F.col("__ok")).drop("__ok")


def first_fit(df: DataFrame, by: list[str], order: list[Column], ok: str) -> DataFrame:
    return ranked(df.where(ok), by, order, "__n").where("__n = 1").drop("__n")


#: Groups of a block; a key of the join holds the pairs of two blocks.
PAIR_BLOCK = 1024


def all_pairs(df: DataFrame, group: str, within: str) -> DataFrame:
    """Unordered pairs of groups within a view, as left < right.

    The groups of a view are cut by their order into blocks, and every two blocks meet
    under a key of their own, so a view's pairs come from many tasks, each of which
    holds a block. Rows are as many as pairs, which grow with the square of a view.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.floor((F.row_number().over(Window.partitionBy(within).orderBy(group)) - 1) / PAIR_BLOCK).cast("int")
    cut = df.where(F.col(within).isNotNull() & F.col(group).isNotNull()).withColumn("__b", block).withColumn("__last", F.max("__b").over(Window.partitionBy(within)))
    key = [within, "__i", "__j"]
    own, other = F.col("__b"), F.explode(F.sequence(F.col("__b"), "__last"))
    left = cut.select(within, own.alias("__i"), other.alias("__j"), *(F.col(c).alias(f"left_{c}") for c in df.columns if c != within))
    right = cut.select(within, F.explode(F.sequence(F.lit(0), own)).alias("__i"), own.alias("__j"), *(F.col(c).alias(f"right_{c}") for c in df.columns if c != within))
    # numbers of tasks are stated, as a few bytes make many pairs
    joined = left.repartition(n, *key).join(right.repartition(n, *key).hint("merge"), key)
    return joined.where(F.col(f"left_{group}") < F.col(f"right_{group}")).drop("__i", "__j")


def pair_counts(df: DataFrame, group: str, within: str, each: int = 1) -> DataFrame:
    """(left, right, within, n): how many rows all_pairs has of each pair, each times; rows are counted before they are paired, so no pair is shuffled."""
    pairs = all_pairs(df.groupBy(group, within).agg(F.count("*").alias("rows")), group, within)
    return pairs.select(f"left_{group}", f"right_{group}", within, (F.col("left_rows") * F.col("right_rows") * each).alias("n"))


#: Groups of all views that go to every task; more are joined by sort-merge.
GROUPS_SENT = 1 << 21
_PRIME = (1 << 31) - 1


def _drawn(seed: int, *columns) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(_PRIME))


def measured_jobs(groups: DataFrame, measured: DataFrame, group: str, within: str, modes: list[str]) -> DataFrame | None:
    """The rows of measured that belong to a job of all_pairs and with_modes, if each job has one row; else None.

    No job is made and none shuffled: rows are held against the groups, which grow with
    the root of the jobs, and per view their number and two sums of products of hashes
    modulo a prime must be those of all jobs, which follow from sums along the sorted
    groups. A view with a job too few or twice passes by an odds of some 1 in 10^17.
    groups are distinct.
    """
    groups = landed(groups.select(group, within).where(F.col(group).isNotNull() & F.col(within).isNotNull()))
    sent = F.broadcast if groups.count() <= GROUPS_SENT else lambda x: x.hint("merge")
    left, right = f"left_{group}", f"right_{group}"
    option = (F.col("region") == "global") & (F.col("mode") == "sequential") | (F.col("region") == "pocket") & F.col("mode").isin(*modes)
    rows = measured.where((F.col(left) < F.col(right)) & option)
    for side in (left, right):
        rows = rows.join(sent(groups.withColumnRenamed(group, side)), [within, side], "left_semi")
    options = [("global", "sequential"), *(("pocket", m) for m in modes)]
    pick, before = Window.partitionBy(within).orderBy(group), Window.partitionBy(within).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    prefix = {f"p{k}": F.coalesce(F.sum(_drawn(k, group)).over(before), F.lit(0)) % _PRIME for k in (0, 1)}
    all_options = {k: sum((_drawn(k + 4, F.lit(r), F.lit(m)) for r, m in options), F.lit(0)) % _PRIME for k in (0, 1)}
    ranked_groups = groups.withColumns(prefix | {"at": F.row_number().over(pick).cast("long") - 1})
    wanted = ranked_groups.groupBy(within).agg((F.sum("at") * len(options)).alias("jobs"), *(F.sum(F.col(f"p{k}") * _drawn(k + 2, group) % _PRIME).alias(f"w{k}") for k in (0, 1)))
    wanted = wanted.where("jobs > 0").select(F.col(within).alias("__v"), "jobs", *((F.col(f"w{k}") % _PRIME * all_options[k] % _PRIME).alias(f"w{k}") for k in (0, 1)))
    # sums by parts of a view stay far from the end of a long
    found = {f"f{k}": _drawn(k, left) * _drawn(k + 2, right) % _PRIME * _drawn(k + 4, "region", "mode") % _PRIME for k in (0, 1)}
    some = rows.groupBy(within, F.pmod(F.xxhash64(left), F.lit(1024)).alias("__p")).agg(F.count("*").alias("rows"), *(F.sum(c).alias(n) for n, c in found.items()))
    seen = some.groupBy(within).agg(F.sum("rows").alias("rows"), *((F.sum(F.col(n) % _PRIME) % _PRIME).alias(n) for n in found))
    both = wanted.join(seen, F.col("__v") == F.col(within), "full")
    same = F.coalesce((F.col("jobs") == F.col("rows")) & (F.col("w0") == F.col("f0")) & (F.col("w1") == F.col("f1")), F.lit(False))
    return None if both.where(~same).limit(1).count() else rows


def with_modes(pairs: DataFrame, modes: list[str]) -> DataFrame:
    """Each pair once for the whole and once for every pocket mode."""
    options = F.array(F.struct(F.lit("global").alias("region"), F.lit("sequential").alias("mode")), *(F.struct(F.lit("pocket").alias("region"), F.lit(m).alias("mode")) for m in modes))
    return pairs.withColumn("o", F.explode(options)).select("*", "o.region", "o.mode").drop("o")


def metrics(at: Callable[[str], Column] = F.col) -> dict[str, Column]:
    shorter = F.least(at("length_1"), at("length_2"))
    return {"max_tm": F.greatest(at("tm_1"), at("tm_2")), "aligned_fraction": F.when(shorter == 0, 0.0).otherwise(at("aligned") / shorter)}


def pair_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns(metrics())


def is_edge(tm: float, aligned: int, fraction: float, rmsd: float, at: Callable[[str], Column] = F.col) -> Column:
    base = (at("max_tm") >= tm) & (at("aligned") >= aligned) & (at("aligned_fraction") >= fraction)
    return F.when(at("region") == "global", base).otherwise(base & (at("rmsd") <= rmsd))


def edge_rollup(evidence: DataFrame, pair: list[str], extra: list[str] | tuple = (), rows: Column | None = None) -> DataFrame:
    """One row per pair: count (of rows for each row of evidence, if given), what it was seen in, and the best evidence with the extra columns asked for."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    best = F.min_by(F.struct("max_tm", "rmsd", *extra), F.struct(-F.col("max_tm"), F.col("rmsd"), F.col("view"), F.col("region"), F.col("mode"))).alias("b")
    return evidence.groupBy(*pair).agg((F.count("*") if rows is None else F.sum(rows)).alias("evidence"), joined("view").alias("views"), joined("region").alias("regions"), joined("mode").alias("modes"), best).select(*pair, "evidence", "views", "regions", "modes", F.col("b.max_tm").alias("best_tm"), F.col("b.rmsd").alias("best_rmsd"), *(F.col(f"b.{c}").alias(f"best_{c}") for c in extra))


#: Rows of one group that all of them carry; pairs of a group with more have their evidence shuffled.
ROWS_CARRIED = 64


def rolled_pairs(df: DataFrame, group: str, within: str, modes: list[str], figures: Callable[[Callable[[str], Column]], dict[str, Column]]) -> DataFrame:
    """edge_rollup of the edges among the jobs of all_pairs and with_modes, made where a pair arises: no pair and no evidence is shuffled.

    figures gives edge, max_tm and rmsd of a job; its argument gives the job's columns
    by name: those of all_pairs, region and mode. Equal rows of a group are counted. A
    group that has several rows still carries all of them, and its pairs come from the
    first two rows that meet in a view, with the jobs of all that do. Rows so carried
    grow with the square of a group's rows, up to ROWS_CARRIED; only groups with more
    have the evidence of their pairs shuffled.
    """
    own_group = Window.partitionBy(group)
    rows = df.where(F.col(group).isNotNull() & F.col(within).isNotNull()).groupBy(*df.columns).agg(F.count("*").alias("__n"))
    rows = rows.withColumn("__m", F.count("*").over(own_group))
    most = F.col("__m") > ROWS_CARRIED
    rolled = _rolled_in_place(rows.where(~most).drop("__m"), group, within, modes, figures)
    if not rows.where(most).limit(1).count():
        return rolled
    pair = [f"left_{group}", f"right_{group}"]
    jobs = with_modes(all_pairs(rows, group, within).where(F.greatest("left___m", "right___m") > ROWS_CARRIED), modes)
    seen = figures(F.col)
    evidence = jobs.select(*pair, F.col(within).cast("string").alias("view"), "region", "mode", (F.col("left___n") * F.col("right___n")).alias("__n"), *(seen[c].alias(c) for c in ("edge", "max_tm", "rmsd")))
    return rolled.unionByName(edge_rollup(evidence.where("edge"), pair, rows=F.col("__n")))


def _rolled_in_place(rows: DataFrame, group: str, within: str, modes: list[str], figures: Callable) -> DataFrame:
    """rolled_pairs of distinct rows, __n times each, whose groups have few."""
    left, right = f"left_{group}", f"right_{group}"
    rest = [c for c in rows.columns if c not in (group, within, "__n")]
    every = F.sort_array(F.collect_list(F.struct(within, *rest, "__n")).over(Window.partitionBy(group)))
    rows = rows.withColumn("__all", every).withColumn("__all", F.when(F.size("__all") > 1, F.col("__all")))
    options = [("global", "sequential"), *(("pocket", m) for m in modes)]

    def jobs(at):
        for region, mode in options:
            told = {"region": F.lit(region), "mode": F.lit(mode)}
            f = figures(lambda c: told[c] if c in told else at(c))  # noqa: B023
            yield region, mode, F.coalesce(f["edge"], F.lit(False)), F.struct((-f["max_tm"]).alias("by"), f["rmsd"].alias("rmsd"), f["max_tm"].alias("max_tm"))

    def row(evidence, views, regions, seen, best):
        return F.struct(evidence.alias("evidence"), views.alias("views"), regions.alias("regions"), seen.alias("modes"), best["max_tm"].alias("best_tm"), best["rmsd"].alias("best_rmsd"))

    # two rows alone: the jobs are columns
    here = list(jobs(F.col))
    names = lambda k: F.concat_ws(";", *(F.when(reduce(or_, (j[2] for j in here if j[k] == v)), F.lit(v)) for v in sorted({j[k] for j in here})))
    count = sum((j[2].cast("long") for j in here), F.lit(0)) * F.col("left___n") * F.col("right___n")
    alone = F.array(row(count, F.col(within).cast("string"), names(0), names(1), F.array_min(F.array(*(F.when(j[2], j[3]) for j in here)))))

    # several: the jobs are an array
    own = {side: F.struct(F.col(within).alias(within), *(F.col(f"{side}_{c}").alias(c) for c in (*rest, "__n"))) for side in ("left", "right")}
    lefts, rights = (F.coalesce(F.col(f"{side}___all"), F.array(x)) for side, x in own.items())
    meetings = F.flatten(F.transform(lefts, lambda x: F.transform(F.filter(rights, lambda y: y[within] == x[within]), lambda y: F.struct(x.alias("left"), y.alias("right")))))

    def evidence(meeting):
        at = lambda c: F.col(c) if c in (left, right) else meeting["left"][c] if c == within else meeting[c.split("_", 1)[0]][c.split("_", 1)[1]]
        told = {"n": meeting["left"]["__n"] * meeting["right"]["__n"], "view": meeting["left"][within].cast("string")}
        return F.array(*(F.when(edge, F.struct(*(c.alias(n) for n, c in told.items()), F.lit(region).alias("region"), F.lit(mode).alias("mode"), best.alias("best"))) for region, mode, edge, best in jobs(at)))

    def rolled(found):
        texts = lambda n: F.array_join(F.sort_array(F.array_distinct(F.transform(found, lambda x: x[n]))), ";")
        return row(F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x["n"]), texts("view"), texts("region"), texts("mode"), F.array_min(F.transform(found, lambda x: x["best"])))

    first = F.struct(own["left"].alias("left"), own["right"].alias("right"))
    # arrays of one, as their elements are worked out once
    several = F.filter(F.array(meetings), lambda m: F.get(m, F.lit(0)).eqNullSafe(first))
    several = F.transform(several, lambda m: F.array_compact(F.flatten(F.transform(m, evidence))))
    several = F.transform(F.filter(several, lambda found: F.size(found) > 0), rolled)

    carried = F.col("left___all").isNotNull() | F.col("right___all").isNotNull()
    pairs = all_pairs(rows, group, within).where(carried | reduce(or_, (j[2] for j in here)))
    # outer, as the optimizer would ask before whether an inner one has rows, and work it out twice
    return pairs.select(left, right, F.when(carried, several).otherwise(alone).alias("__r")).select(left, right, F.inline_outer("__r")).where("evidence IS NOT NULL")


def or_blank(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """The table, or one row of blanks if it is empty.

    source has rows exactly if the table has, and is asked in its place; without one
    the table is written first, so that it is planned once.
    """
    df = landed(df) if source is None else df
    if (df if source is None else source).limit(1).count():
        return df
    return df.sparkSession.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))


def waterfall(rules: list[tuple[Column, str]], last: str) -> Column:
    """The name of the first rule that holds; null counts as not."""
    out = None
    for when, name in rules:
        out = F.when(F.coalesce(when, F.lit(False)), name) if out is None else out.when(F.coalesce(when, F.lit(False)), name)
    return out.otherwise(last)


def batches(ids: DataFrame, id_col: str, size: int) -> DataFrame:
    """Sorted ids in batches. Ranks come from range partitions and their counts, so no task sorts all ids."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    return global_rank(ids, id_col).withColumn("batch", F.floor(F.col("rank") / size))


def global_rank(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Zero-based rank by a unique key of any type: range partitions written once, their counts summed, ranks inside."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = landed(df.repartitionByRange(n, key).withColumn("__b", F.spark_partition_id()))
    counts = sorted((r[0], r[1]) for r in d.groupBy("__b").count().collect())  # one row a partition
    offset, rows = 0, []
    for b, size in counts:
        rows.append((b, offset))
        offset += size
    offsets = df.sparkSession.createDataFrame(rows, "__b int, __o long")
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1
    return d.withColumn("__r", inside).join(F.broadcast(offsets), "__b").withColumn("rank", F.col("__o") + F.col("__r")).drop("__b", "__o", "__r")


def verify_ledger(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(source_id, path, status): the first violation of each file of either side.

    A null is a violation, never a match: blank or repeated ids and paths, paths
    that leave the root, files that are not there, and sizes or digests that differ
    or are not stated. Digests count without regard to case.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    often = lambda c: F.count("*").over(Window.partitionBy(c)) > 1
    e = expected.select("source_id", "path", F.col("bytes").alias("eb"), F.lower("sha256").alias("eh")).withColumns({"__ids": often("source_id"), "__paths": often("path")})
    o = observed.select(F.col("path").alias("opath"), F.col("bytes").alias("ob"), F.lower("sha256").alias("oh"))
    listed = F.col("__ids").isNotNull()
    outside = F.startswith("path", F.lit("/")) | F.array_contains(F.split("path", "/"), "..")
    rules = [
        (~listed, "unlisted"), (blank("source_id"), "no_id"), (F.col("__ids"), "duplicate_id"), (blank("path"), "no_path"), (F.col("__paths"), "duplicate_path"), (outside, "outside"),
        (F.col("opath").isNull(), "missing"), (~F.coalesce(F.col("eb") == F.col("ob"), F.lit(False)), "bytes"), (~F.coalesce(F.col("eh") == F.col("oh"), F.lit(False)), "sha256"),
    ]
    rules = [(F.coalesce(c, F.lit(False)), n) for c, n in rules[:1]] + rules[1:]
    joined = e.join(o, e["path"] == o["opath"], "full")
    return joined.select("source_id", F.coalesce("path", "opath").alias("path"), waterfall(rules, "verified").alias("status"))


def verified(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(source_id, path, bytes, sha256) of a ledger that holds in every row and is not empty; else an error names the first violations."""
    if not expected.limit(1).count():
        raise ProvenanceError("a ledger must list files")
    bad = verify_ledger(expected, observed).where(~F.col("status").isin("verified", "unlisted")).limit(5).collect()
    if bad:
        raise ProvenanceError(f"{[r.asDict() for r in bad]}")
    return expected.select("source_id", "path", "bytes", F.lower("sha256").alias("sha256"))


def scatter_add(source: DataFrame, index: str, value: str, size: int | None = None) -> DataFrame:
    """Sums by index over 0..size-1, with zeros for indices that do not occur; size defaults to one more than the largest.

    A null index, or one outside of the size, is an error.
    """
    low, high, nulls = source.agg(F.min(index), F.max(index), F.count_if(F.col(index).isNull())).first()
    n = size if size is not None else (0 if high is None else int(high) + 1)
    if nulls or (high is not None and (low < 0 or high >= n)):
        raise ContractError(f"indices {low} to {high} with {nulls} nulls do not fit {n} places")
    got = source.groupBy(F.col(index).cast("long").alias("id")).agg(F.sum(value).alias("s"))
    return source.sparkSession.range(n).join(got, "id", "left").select(F.col("id").alias("index"), F.coalesce("s", F.lit(0.0)).alias("value"))


def pool(vectors: DataFrame, by: list[str], vec: str) -> DataFrame:
    """Mean and population standard deviation of each component."""
    flat = vectors.select(*by, F.posexplode(vec).alias("dim", "value"))
    return flat.groupBy(*by, "dim").agg(F.avg(F.col("value").cast("double")).alias("mean"), F.stddev_pop(F.col("value").cast("double")).alias("std"))


def pooled_vector(vectors: DataFrame, by: list[str], vec: str) -> DataFrame:
    """(by, pooled): the components' means followed by their population standard deviations, as one array."""
    each = pool(vectors, by, vec).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("p"))
    return each.select(*by, F.concat(F.transform("p", lambda x: x["mean"]), F.transform("p", lambda x: x["std"])).alias("pooled"))


def overlap_average(windows: DataFrame, by: list[str]) -> DataFrame:
    """Positions of several windows are averaged first, then all positions with equal weight. windows: by, start, values."""
    flat = windows.select(*by, "start", F.posexplode("values").alias("i", "value"))
    at = flat.groupBy(*by, (F.col("start") + F.col("i")).alias("position")).agg(F.avg("value").alias("value"))
    return at.groupBy(*by).agg(F.count("*").alias("positions"), F.avg("value").alias("value"))


def overlap_average_vectors(windows: DataFrame, by: list[str]) -> DataFrame:
    """(by, vector) of windows (by, start, states): positions of several windows are averaged first, then all positions with equal weight."""
    rows = windows.select(*by, "start", F.posexplode("states").alias("i", "state"))
    flat = rows.select(*by, (F.col("start") + F.col("i")).alias("position"), F.posexplode("state").alias("dim", "value"))
    at = flat.groupBy(*by, "position", "dim").agg(F.avg("value").alias("value"))
    means = at.groupBy(*by, "dim").agg(F.avg("value").alias("value"))
    each = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("p"))
    return each.select(*by, F.transform("p", lambda x: x["value"]).alias("vector"))


def tier_counts(views: DataFrame, column: str, tiers: list[str]) -> DataFrame:
    """One row with the number of rows of each tier, 0 for those that do not occur, and of all rows."""
    return views.agg(*(F.count_if(F.col(column) == t).alias(f"{t}_views") for t in tiers), F.count("*").alias("rows"))


#: Members of all sets of views that go to every task; with more, pairs are sorted.
MEMBERS_SENT = 1 << 20


def ordered_pairs(df: DataFrame, group: str, within: str, modes: list[str]) -> DataFrame:
    """The rows of all_pairs and with_modes in the order of left, right, view, region and mode, without a sort of pairs.

    Left groups are sorted, and each meets the sorted members of its views, which are
    broadcast once for every set of views; so rows come out in order. Beyond
    MEMBERS_SENT members pairs are sorted before the modes are added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = f"left_{group}", f"right_{group}"
    own = df.select(group, within).where(F.col(group).isNotNull() & F.col(within).isNotNull())
    sets = own.groupBy(group).agg(F.sort_array(F.collect_list(within)).alias("__s"))
    kinds = sets.select("__s").distinct().withColumn(within, F.explode("__s")).groupBy("__s", within).agg(F.count("*").alias("__k"))
    members = kinds.join(own.groupBy(group, within).agg(F.count("*").alias("n")), within).withColumn("n", F.col("n") * F.col("__k"))
    if members.count() <= MEMBERS_SENT:
        lists = members.groupBy("__s").agg(F.sort_array(F.collect_list(F.struct(group, within, "n"))).alias("__m"))
        lefts = sets.select(F.col(group).alias(left), "__s").repartitionByRange(n, left).sortWithinPartitions(left)
        # rows pass as they are: Spark drops a sort below a join unless something stands between
        lefts = lefts.mapInArrow(lambda batches: batches, lefts.schema)
        met = lefts.join(F.broadcast(lists), "__s").select(left, F.explode("__m").alias("m"))
        pairs = met.select(left, F.col(f"m.{group}").alias(right), f"m.{within}", "m.n").where(F.col(left) < F.col(right))
    else:
        pairs = pair_counts(own, group, within).orderBy(left, right, within)
    # repeated groups make equal rows, which stand together
    return with_modes(pairs, sorted(modes)).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")


def sorted_pairs(pairs: DataFrame) -> DataFrame:
    """The pair table in the order of its groups, view, region and mode."""
    return pairs.orderBy("left_construct_group_id", "right_construct_group_id", "view", "region", "mode")


def sorted_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("left_construct_group_id", "right_construct_group_id")


def sorted_coordinates(records: DataFrame, key: str = "pdb_id") -> DataFrame:
    return records.orderBy(key)


def tiered(df: DataFrame, tiers: dict[str, dict[str, Column]], keep: list[str]) -> DataFrame:
    """One row of each tier for every row, the first tier first: keep, tier, and the tier's own columns, in one pass."""
    options = F.array(*(F.struct(F.lit(t).alias("tier"), *(x.alias(c) for c, x in own.items())) for t, own in tiers.items()))
    return df.select(*keep, F.explode(options).alias("__t")).select(*keep, "__t.*")
