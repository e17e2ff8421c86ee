"""Bagged forests whose bags are known: out-of-bag error, votes and importance.

Spark ML's forest does not tell which rows a tree left out.  Here a row's bootstrap count is a function of (row
key, tree, seed): any task of any job knows a row's bag without a stored matrix, and a lost task draws the same
bags again.  The trees are those of ``trees``, which follow Spark ML's: thresholds are sought once per forest, on
at most some 10,000 rows as in Spark, and rows are held as their bins.

Rows whose bins take at most ``LOCAL_BYTES`` go to the tasks whole, and each task grows its own trees (``grown_in_tasks``).
More rows stay where they are: a job counts a level's cells for many trees and nodes at once, and adds them up by
node (``grown_by_level``).  Both give the same trees.

Case weights act on the draw (``case_weights="bootstrap"``: a row's expected
count is its weight over the mean weight) or on the impurity
(``"impurity"``: counts are Poisson(1), the tree sees weight x count).

Out-of-bag results are mergeable counters: for each training row and interval
of trees (trees, votes, sum of probabilities), added up while the trees of the
interval score the row.  One row per training row and interval is written;
every error for any number of trees at an interval's end follows by adding.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext, TaskContext, cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.operators import trees as trees_module
from carrisk.operators.trees import LARGE_RATE, Bags, Best, Growth, Rules, Tree, best_splits, binned, grow, leaves, partial_codes, split_points
from carrisk.session import checkpoint, scratch_path

CHUNK = 10  # trees that a task grows
PAIRS = 400_000  # (tree, row) pairs that are grown at once
LOCAL_BYTES = 64 << 20  # packed rows that go to a task whole
JOB_NODES = 4096  # nodes whose cells a job of ``grown_by_level`` counts

cloudpickle.register_pickle_by_value(trees_module)  # workers need not have this package


class ForestModel(RandomForestClassificationModel):
    """Spark's model, whose Python objects of single trees are made when they are asked for.

    ``Params`` reads every attribute that is no ``property`` whenever a model is made or copied; Spark's ``trees`` is a
    cached one, so that each fit made a Python object, and called the JVM for every param, of every tree.
    """
    @property
    def trees(self):
        return super().trees


class Forest(RandomForestClassifier):
    """Spark's classifier; its fits give a ``ForestModel``."""

    def _create_model(self, java_model) -> ForestModel:
        return ForestModel(java_model)


def detached(model: RandomForestClassificationModel) -> RandomForestClassificationModel:
    """``model`` without its training summary: that holds the session and the training frame, and goes
    with the model into every scoring task."""
    model._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def sized(df: DataFrame, rows_per_partition: int = 100_000) -> DataFrame:
    """Repartition a frame that many small fits will read to ~``rows_per_partition`` rows
    per partition: tiny tuning sets become one task per level job instead of
    many near-empty ones, and the count still grows with the data."""
    n = df.count()
    return df.repartition(max(1, math.ceil(n / rows_per_partition)))


def assembler(features) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


# ---------------------------------------------------------------- bags
def uniform(key: Column, *salt) -> Column:
    """A number in [0, 1) by hash of (key, salt)."""
    h = F.xxhash64(key.cast("string"), *[F.lit(s) for s in salt])
    return h.bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))


def is_out_of_bag(key: Column, tree: int, seed: int, rate: Column) -> Column:
    """Whether ``bag_count`` is 0."""
    return F.when(rate > LARGE_RATE, F.lit(False)).otherwise(uniform(key, tree, seed) < F.exp(-rate))


def cumulative(rate: Column) -> Column:
    """P(count <= 0), P(count <= 1), ... of a Poisson(rate) count; the same for every tree of a row."""
    step = lambda a, k: F.struct((a["p"] * rate / k).alias("p"), (a["cdf"] + a["p"] * rate / k).alias("cdf"),
                                 F.array_append(a["below"], a["cdf"]).alias("below"))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.array().cast("array<double>").alias("below"))
    most = F.ceil(rate + 10 * F.sqrt(rate) + 12).cast("int")
    return F.when(~(rate > LARGE_RATE), F.aggregate(F.sequence(F.lit(1), most), start, step)["below"])


def drawn(u: Column, key: Column, tree: int | Column, seed: int, rate: Column, below: Column) -> Column:
    """``bag_count`` from the row's number ``u`` and its ``cumulative`` shares ``below``."""
    v = uniform(key, tree, seed, "normal")
    z = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)
    large = F.greatest(F.lit(1), F.round(rate + F.sqrt(rate) * z).cast("int"))
    return F.when(rate > LARGE_RATE, large).otherwise(F.size(F.filter(below, lambda p: u >= p)))


def bag_count(key: Column, tree: int, seed: int, rate: Column) -> Column:
    """Bootstrap count ~ Poisson(rate): inverse CDF at the row's hash; above a rate of ``LARGE_RATE``
    the rounded normal limit, at least 1."""
    return drawn(uniform(key, tree, seed), key, tree, seed, rate, cumulative(rate))


def with_bags(data: DataFrame, numbers: Sequence[int], key: str, seed: int, rate: Column) -> DataFrame:
    """``data`` + ``_bags``: the row's counts in the trees first..last of ``numbers``.

    One expression whatever their number: a tree's job then reads its count, where a count spelled out per tree
    has its own code to plan and compile in every fit.  Shares and hashes are bound by ``transform``, so that a
    row's shares are summed once and a tree's hash is taken once.
    """
    hashes = F.transform(F.sequence(F.lit(numbers[0]), F.lit(numbers[-1])), lambda t: uniform(F.col(key), t, seed))
    counts = lambda below: F.transform(hashes, lambda u, i: drawn(u, F.col(key), i + F.lit(numbers[0]), seed, rate, below))
    return data.withColumn("_bags", F.transform(F.array(cumulative(rate)), counts)[0])


# ---------------------------------------------------------------- rows for the trees
def values(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def key_hash(key: str) -> Column:
    """What ``uniform`` hashes first; tree and seed follow."""
    return F.xxhash64(F.col(key).cast("string"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of an array column; NULL is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def rows_for_trees(train: DataFrame, features: Sequence[str], key: str, *more: Column) -> DataFrame:
    """(h, y, w, x, more...): key hash, label, case weight (none is 0) and feature values, with the way to them cut."""
    return checkpoint(train.select(key_hash(key).alias("h"), F.col("label").cast("double").alias("y"),
                                   F.coalesce("weight", F.lit(0.0)).cast("double").alias("w"), values(features).alias("x"), *more))


def thresholds(data: DataFrame, n: int, width: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """Candidate thresholds of every feature, from all rows or, as Spark ML does, some 10,000 of them (by hash of the key)."""
    wanted = max(max_bins ** 2, 10_000)
    if n > wanted:
        data = data.where(F.pmod(F.xxhash64("h", F.lit(f"{seed}|splits")), F.lit(1 << 30)) < int(wanted / n * (1 << 30)))
    rows = data.select("x", "w").toArrow().combine_chunks()
    x, w = matrix(rows["x"].combine_chunks(), width), rows["w"].to_numpy()
    return [split_points(x[:, f], w, min(max_bins, max(n, 1)) - 1) for f in range(width)]


PACKED = {"h": np.uint64, "y": np.int8, "w": np.float64}


def packed(data: DataFrame, splits: list[np.ndarray], *more: str) -> DataFrame:
    """The rows in blocks: one value of bytes per column (``more``: small integers), ``x`` as its bins."""
    width, names = len(splits), list(more)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                if b["y"].null_count:
                    raise ValueError("a label is NULL")
                columns = [b["h"].to_numpy().view(np.uint64), (b["y"].to_numpy() > 0.5).astype(np.int8), b["w"].to_numpy(),
                           binned(matrix(b["x"], width), splits), *[b[m].to_numpy().astype(np.int8) for m in names]]
                yield pa.RecordBatch.from_pylist([dict(zip(["h", "y", "w", "x", *names], [c.tobytes() for c in columns]))])

    return data.select("h", "y", "w", "x", *names).mapInArrow(pack, ", ".join(f"{c} binary" for c in ("h", "y", "w", "x", *names)))


def bin_type(splits: list[np.ndarray]) -> type:
    return np.uint8 if all(len(s) < 256 for s in splits) else np.uint16


def brought(blocks: DataFrame, splits: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The rows of all blocks in one array per column, in an order that does not hang on the blocks."""
    found = blocks.collect()
    kinds = {c: PACKED.get(c, np.int8) for c in blocks.columns} | {"x": bin_type(splits)}
    out = {c: np.frombuffer(b"".join(r[c] for r in found), kind) for c, kind in kinds.items()}
    out["x"] = out["x"].reshape(-1, len(splits))
    order = np.argsort(out["h"], kind="stable")
    return {c: v[order] for c, v in out.items()}


def bag(bags: Bags, tree: int, w: np.ndarray, biased: bool, copies: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, weights, numbers of rows) of the rows that ``tree`` sees.  ``copies``: a row drawn twice counts as two."""
    count = bags.counts(tree)
    weight = count.astype(np.float64) if biased else w * count
    rows = np.flatnonzero(weight > 0)
    return rows, weight[rows], count[rows] if copies else np.ones(len(rows), np.int64)


def grown(numbers: Sequence[int], x: np.ndarray, y: np.ndarray, w: np.ndarray, bags: Bags, rules: Rules, splits: list[np.ndarray],
          biased: bool, copies: bool) -> Iterator[Tree]:
    """Trees ``numbers`` on rows in memory, as many at a time as ``PAIRS`` allows.  A bag that holds no row is the whole frame."""
    some = max(1, PAIRS // max(1, len(y)))
    for first in range(0, len(numbers), some):
        part = numbers[first:first + some]
        drawn_rows = [bag(bags, t, w, biased, copies) for t in part]
        whole = np.arange(len(y)), np.ones(len(y)), np.ones(len(y), np.int64)
        yield from grow(part, x, y, [d if len(d[0]) else whole for d in drawn_rows], rules, splits)


def in_tasks(spark: SparkSession, tasks: Sequence, one: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``one(task)`` yields for each of ``tasks``, each in a task of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place in b["id"].to_pylist():
                yield from one(tasks[place])

    return spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, schema)


def fits_a_task(n: int, width: int) -> bool:
    return n * (width + 17) <= LOCAL_BYTES


def grown_in_tasks(blocks: DataFrame, splits: list[np.ndarray], rules: Rules, trees: int, mean_weight: float | None) -> list[Tree]:
    """Trees 1..``trees``, each grown whole in a task that holds all rows."""
    spark = blocks.sparkSession
    rows = spark.sparkContext.broadcast(brought(blocks, splits))
    biased = mean_weight is not None

    def one(numbers: range) -> Iterator[pa.RecordBatch]:
        r = rows.value
        bags = Bags(r["h"], r["w"] / mean_weight if biased else np.ones(len(r["h"])), rules.seed)
        for t, tree in zip(numbers, grown(numbers, r["x"], r["y"], r["w"], bags, rules, splits, biased, False)):
            yield pa.RecordBatch.from_pylist([{"t": t, "code": tree.code.tobytes(), "prob": tree.prob.tobytes(), "importance": tree.importance.tobytes()}])

    chunks = [range(first, min(first + CHUNK, trees + 1)) for first in range(1, trees + 1, CHUNK)]
    try:
        found = in_tasks(spark, chunks, one, "t long, code binary, prob binary, importance binary").collect()
    finally:
        rows.destroy()
    return [Tree(np.frombuffer(r["code"], np.int64), np.frombuffer(r["prob"]), np.frombuffer(r["importance"]), splits)
            for r in sorted(found, key=lambda r: r["t"])]


def grown_by_level(blocks: DataFrame, splits: list[np.ndarray], rules: Rules, trees: int, mean_weight: float | None, copies: bool = False) -> list[Tree]:
    """Trees 1..``trees``, a level of ``CHUNK`` trees at a time: rows stay in their blocks, cells are added up by node."""
    biased, bin_kind, width = mean_weight is not None, bin_type(splits), len(splits)

    def level(growth: Growth, first: int, end: int, subset: np.ndarray) -> list[Best]:
        numbers, part_nodes, bins = growth.numbers, max(1, JOB_NODES // 16), rules.bins
        code, open_at = partial_codes(growth)
        owners = np.unique(growth.levels[-1][0][growth.active[first:end]]).tolist()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, m = end - first, subset.shape[1]
            weights, rows = np.zeros((m, n * bins * 2)), np.zeros((m, n * bins))
            for batch in batches:
                for b in batch.to_pylist():
                    h, y, w = (np.frombuffer(b[c], kind) for c, kind in PACKED.items())
                    x = np.frombuffer(b["x"], bin_kind).reshape(-1, width)
                    bags = Bags(h, w / mean_weight if biased else np.ones(len(h)), rules.seed)
                    for k in owners:
                        seen, weight, number = bag(bags, int(numbers[k]), w, biased, copies)
                        at = open_at[leaves(code, x[seen], k)]
                        here = (at >= first) & (at < end)
                        node, own, weight, number = at[here] - first, x[seen[here]], weight[here], number[here]
                        for j in range(m):
                            cell = node * bins + own[np.arange(len(own)), subset[first + node, j]]
                            weights[j] += np.bincount(cell * 2 + y[seen[here]], weight, n * bins * 2)
                            rows[j] += np.bincount(cell, number, n * bins)
            task = TaskContext.get().partitionId()
            weights, rows = weights.reshape(m, n, bins, 2), rows.reshape(m, n, bins)
            for a in range(0, n, part_nodes):
                yield pa.RecordBatch.from_pylist([{"part": a, "task": task, "weights": weights[:, a:a + part_nodes].tobytes(), "rows": rows[:, a:a + part_nodes].tobytes()}])

        def choose(found: pa.Table) -> pa.Table:
            sums = sorted(found.to_pylist(), key=lambda r: r["task"])
            a = sums[0]["part"]
            own = subset[first + a:min(first + a + part_nodes, end)]
            weights = sum(np.frombuffer(r["weights"]) for r in sums).reshape(own.shape[1], len(own), bins, 2)
            rows = sum(np.frombuffer(r["rows"]) for r in sums).reshape(own.shape[1], len(own), bins)
            best = best_splits(list(zip(weights, rows)), own, rules.node_size)
            return pa.Table.from_pylist([{"part": a} | {c: getattr(best, c).tobytes() for c in ("gain", "feature", "split", "left", "total")}])

        cells = blocks.mapInArrow(count, "part long, task long, weights binary, rows binary")
        found = cells.groupBy("part").applyInArrow(choose, "part long, gain binary, feature binary, split binary, left binary, total binary").collect()
        return [Best(np.frombuffer(r["gain"]), np.frombuffer(r["feature"], np.int64), np.frombuffer(r["split"], np.int64),
                     np.frombuffer(r["left"]).reshape(-1, 2), np.frombuffer(r["total"]).reshape(-1, 2)) for r in sorted(found, key=lambda r: r["part"])]

    out = []
    for start in range(1, trees + 1, CHUNK):
        growth = Growth(np.arange(start, min(start + CHUNK, trees + 1)), rules)
        while len(growth.active):
            subset = growth.subset()
            parts = [b for first in range(0, len(subset), JOB_NODES) for b in level(growth, first, min(first + JOB_NODES, len(subset)), subset)]
            growth.split(Best(*[np.concatenate([getattr(b, c) for b in parts]) for c in ("gain", "feature", "split", "left", "total")]))
        out += growth.trees(splits)
    return out


def fold_scores(tune: DataFrame, features: Sequence[str], configs: Sequence[tuple[int, int]], folds: int, trees: int, key: str = "dot_number",
                seed: int = 42, max_depth: int = 30, max_bins: int = 64, piece: int = 50) -> DataFrame:
    """M9: (mtry, min_node_size, fold, positive, prob): each row's P(positive) by forests fitted on the other folds of ``tune``.

    ``tune`` has (key, label, weight, fold, features).  A forest's trees see weight x count on Poisson(1) bags, and
    copies of a row count as rows, as in Spark ML's forests.  ``piece`` trees share a task, which
    adds up their probabilities; these sums are added in the order of the trees.
    """
    spark, width = tune.sparkSession, len(features)
    data = rows_for_trees(tune, features, key, F.col("fold").cast("int").alias("fold"))
    sizes = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    n, numbers = sum(sizes.values()), range(1, trees + 1)
    held = []  # per fold: thresholds of the other folds' rows, and all rows in their bins
    for k in range(folds):
        splits = thresholds(data.where(F.col("fold") != k), n - sizes.get(k, 0), width, max_bins, seed)
        held.append((splits, packed(data, splits, "fold")))
    rules = {(m, s): Rules(width, m, s, max_bins, max_depth, seed) for m, s in configs}
    if not fits_a_task(n, width):
        parts = []
        for k, (splits, blocks) in enumerate(held):
            others = checkpoint(packed(data.where(F.col("fold") != k), splits))
            for m, s in configs:
                found = grown_by_level(others, splits, rules[m, s], trees, None, copies=True)
                scored = BaggedForest(found, tuple(f"_x{i}" for i in range(width)), key, seed, None, splits).score(
                    data.where(F.col("fold") == k).select("y", *[F.get("x", F.lit(i)).alias(f"_x{i}") for i in range(width)]))
                parts.append(scored.select(F.lit(m).alias("mtry"), F.lit(s).alias("min_node_size"), F.lit(k).alias("fold"), (F.col("y") > 0.5).alias("positive"), "prob"))
        return reduce(DataFrame.unionByName, parts)
    rows = [spark.sparkContext.broadcast(brought(blocks, splits)) for splits, blocks in held]
    splits = [s for s, _ in held]

    def one(task: tuple[int, int, int, range]) -> Iterator[pa.RecordBatch]:
        m, s, k, own = task
        r = rows[k].value
        fitted, kept = np.flatnonzero(r["fold"] != k), np.flatnonzero(r["fold"] == k)
        x, y, w, h = (r[c][fitted] for c in ("x", "y", "w", "h"))
        total, scored = np.zeros(len(kept)), r["x"][kept]
        for tree in grown(own, x, y, w, Bags(h, np.ones(len(h)), seed), rules[m, s], splits[k], False, True):
            total += tree.prob[leaves(tree.code, scored)]
        same = lambda v: pa.array(np.full(len(kept), v, np.int32))
        yield pa.RecordBatch.from_arrays([same(m), same(s), same(k), pa.array(kept.astype(np.int64)), pa.array(r["y"][kept] > 0), same(own[0]), pa.array(total)],
                                         names=["mtry", "min_node_size", "fold", "row", "positive", "first", "total"])

    pieces = [numbers[i:i + piece] for i in range(0, trees, piece)]
    tasks = [(m, s, k, own) for m, s in sorted(configs, key=lambda c: (c[1], -c[0])) for k in range(folds) for own in pieces]  # the longest first
    sums = in_tasks(spark, tasks, one, "mtry int, min_node_size int, fold int, row long, positive boolean, first int, total double")
    in_order = F.array_sort(F.collect_list(F.struct("first", "total")))
    prob = F.aggregate(in_order, F.lit(0.0), lambda a, p: a + p["total"]) / F.lit(float(trees))
    scores = checkpoint(sums.groupBy("mtry", "min_node_size", "fold", "row", "positive").agg(prob.alias("prob")).drop("row"))
    for r in rows:
        r.destroy()
    return scores


# ---------------------------------------------------------------- the forest
@dataclass
class BaggedForest:
    """Trees 1..n with the rule of their bags.  ``mean_weight`` is None where weights act on the impurity."""
    trees: list[Tree]
    features: tuple[str, ...]
    key: str
    seed: int
    mean_weight: float | None
    splits: list[np.ndarray] = field(default_factory=list)

    def rate(self, weight: Column) -> Column:
        """A row's expected bootstrap count."""
        return F.lit(1.0) if self.mean_weight is None else F.coalesce(weight, F.lit(0.0)) / F.lit(self.mean_weight)

    def leaves_out(self, tree: int, key: Column, weight: Column) -> Column:
        return is_out_of_bag(key, tree, self.seed, self.rate(weight))

    def featureImportances(self) -> list[float]:  # noqa: N802 - as Spark's models name it
        """Mean impurity importance over the trees, normalised to 1 (zeros where no tree splits)."""
        sums = [0.0] * len(self.features)
        for tree in self.trees:
            sums = [a + b for a, b in zip(sums, tree.importance.tolist())]
        total = sum(sums)
        return [s / total if total else 0.0 for s in sums]

    def scorer(self, spark: SparkSession, numbers: Sequence[int] | None = None) -> Callable[[np.ndarray], Iterator[np.ndarray]]:
        """A function for tasks: the probabilities of rows of feature values by each tree (of ``numbers``) in turn."""
        splits = self.splits
        sent = spark.sparkContext.broadcast([(self.trees[t - 1].code, self.trees[t - 1].prob) for t in numbers or range(1, len(self.trees) + 1)])

        def scores(x: np.ndarray) -> Iterator[np.ndarray]:
            bins = binned(x, splits)
            return (prob[leaves(code, bins)] for code, prob in sent.value)
        return scores

    def score(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """``df`` + P(positive): the mean of the trees' probabilities.  No shuffle."""
        scores, n = self.scorer(df.sparkSession), float(max(len(self.trees), 1))

        def mean(x: pd.Series) -> pd.Series:
            total = np.zeros(len(x))
            for p in scores(np.stack(x.to_list()).astype(np.float64)) if len(x) else ():
                total += p
            return pd.Series(total / n)
        return df.select(*df.columns, F.pandas_udf(mean, "double")(values(self.features)).alias(out))

    def with_tree_scores(self, df: DataFrame, numbers: Sequence[int], keep: Sequence[str], columns: dict[str, Column]) -> DataFrame:
        """``keep`` and ``columns``, which may use ``_p<t>``, the probability by tree t of ``numbers``; ``df`` has the vector ``features``."""
        scores, n = self.scorer(df.sparkSession, list(numbers)), len(numbers)

        def each(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(list(scores(np.stack(x.to_list()).astype(np.float64))), axis=1)) if len(x) else [], dtype=object)
        scored = df.withColumn("_p", F.pandas_udf(each, "array<double>")(vector_to_array("features")))
        apart = scored.select(*df.columns, *[F.get("_p", F.lit(i)).alias(f"_p{t}") for i, t in enumerate(numbers)])
        return apart.select(*keep, *[c.alias(name) for name, c in columns.items()])


def fit(train: DataFrame, features: Sequence[str], mtry: int, node_size: int, trees: int, key: str = "dot_number",
        case_weights: str = "bootstrap", seed: int = 42, max_depth: int = 30, max_bins: int = 64) -> BaggedForest:
    """M8: ``trees`` trees on bags of ``train`` (key, label 0/1, weight, features).

    ``node_size`` bounds the distinct rows of a child.  A bag that holds no row is drawn from the whole frame
    instead (frames of a few rows only).
    """
    if case_weights not in ("bootstrap", "impurity"):
        raise ValueError("case_weights: bootstrap or impurity")
    data = rows_for_trees(train, features, key)
    n = data.count()
    mean = train.agg(F.avg("weight")).first()[0] if case_weights == "bootstrap" else None
    splits = thresholds(data, n, len(features), max_bins, seed)
    rules = Rules(len(features), mtry, node_size, max_bins, max_depth, seed)
    blocks = packed(data, splits)
    if fits_a_task(n, len(features)):
        found = grown_in_tasks(blocks, splits, rules, trees, mean)
    else:
        found = grown_by_level(checkpoint(blocks), splits, rules, trees, mean)
    return BaggedForest(found, tuple(features), key, seed, mean, splits)


# ---------------------------------------------------------------- out-of-bag counters
def intervals(trees: int, steps: Sequence[int] = ()) -> list[tuple[int, int]]:
    """(first, last) tree of each interval that ends at a step, or at the last tree."""
    ends = sorted({s for s in steps if 0 < s < trees} | {trees})
    return list(zip([1, *[e + 1 for e in ends[:-1]]], ends))


def oob_counters(forest: BaggedForest, train: DataFrame, steps: Sequence[int] = (), rows_per_task: int = 2000) -> DataFrame:
    """(key, label, upto, n, votes, prob): per training row and interval, over the trees that left the row out.

    ``upto`` is the interval's last tree.  All intervals come from one pass over the training rows, written as one
    table; rows in every bag of an interval have no counter there.
    """
    spark, key, width, seed = train.sparkSession, forest.key, len(forest.features), forest.seed
    path = scratch_path(spark, f"oob-{uuid.uuid4().hex[:12]}")
    scores, spans = forest.scorer(spark), intervals(len(forest.trees), steps)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bags = Bags(b["h"].to_numpy().view(np.uint64), b["rate"].to_numpy(), seed)
            each = scores(matrix(b["x"], width))
            for first, last in spans:
                n, votes, prob = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
                for t in range(first, last + 1):
                    out, p = bags.left_out(t), next(each)
                    n += out
                    votes += out & (p > 0.5)
                    prob += np.where(out, p, 0.0)
                some = pa.array(np.flatnonzero(n > 0))
                rows = [b[key].take(some), b["label"].take(some), *[pa.array(v).take(some) for v in (n, votes, prob, np.full(b.num_rows, last, np.int32))]]
                yield pa.RecordBatch.from_arrays(rows, names=[key, "label", "n", "votes", "prob", "upto"])

    schema = f"{key} {train.schema[key].dataType.simpleString()}, label double, n int, votes int, prob double, upto int"
    data = sized(train.select(key, F.col("label").cast("double").alias("label"), key_hash(key).alias("h"),
                              forest.rate(F.col("weight")).alias("rate"), values(forest.features).alias("x")), rows_per_task)
    data.mapInArrow(count, schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def oob_error(counters: DataFrame, key: str = "dot_number") -> DataFrame:
    """One row (brier, error, n_rows): mean squared error of the out-of-bag probability, share of wrong majorities,
    rows with an out-of-bag tree."""
    row = counters.groupBy(key, "label").agg(F.sum("n").alias("n"), F.sum("votes").alias("votes"), F.sum("prob").alias("prob"))
    p, vote = F.col("prob") / F.col("n"), F.col("votes") / F.col("n") >= 0.5
    return row.agg(F.avg(F.pow(p - F.col("label"), 2)).alias("brier"), F.avg((vote.cast("double") != F.col("label")).cast("double")).alias("error"),
                   F.count(F.lit(1)).alias("n_rows"))


def oob_curve(counters: DataFrame, steps: Sequence[int], key: str = "dot_number") -> DataFrame:
    """(num_trees, oob_error) for the first n trees, n in ``steps``: wrong majorities among rows with a vote."""
    upto = lambda name, n: F.sum(F.when(F.col("upto") <= n, F.col(name)))
    row = counters.groupBy(key, "label").agg(*[(upto("votes", n) / upto("n", n)).alias(f"s{n}") for n in steps])
    wrong = lambda n: ((F.col(f"s{n}") >= 0.5).cast("double") != F.col("label")).cast("double")
    wide = row.agg(*[F.avg(wrong(n)).alias(f"e{n}") for n in steps])
    pairs = F.array(*[F.struct(F.lit(n).alias("num_trees"), F.col(f"e{n}").alias("oob_error")) for n in steps])
    return wide.select(F.inline(pairs)).orderBy("num_trees")


# ---------------------------------------------------------------- out-of-bag permutation importance
def gathered(train: DataFrame, forest: BaggedForest, bucket_rows: int = 1000) -> DataFrame:
    """Training rows in buckets of about ``bucket_rows`` by a hash of the key, in a second hash order within: the one shuffle."""
    n = train.count()
    hashed = lambda what: F.xxhash64(F.col(forest.key).cast("string"), F.lit(f"{forest.seed}|{what}"))
    row = F.struct(hashed("order").alias("o"), F.col(forest.key), F.col("label"), F.col("weight"),
                   F.array(*[F.col(f).cast("double") for f in forest.features]).alias("x"))
    buckets = train.groupBy(F.pmod(hashed("bucket"), F.lit(max(1, n // bucket_rows))).alias("bucket")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return checkpoint(buckets)


def oob_copies(buckets: DataFrame, forest: BaggedForest, t: int) -> DataFrame:
    """(j, label, x): the rows that tree ``t`` left out, as they are (j = -1) and with feature j's values moved.

    The moves are array functions over the features, so the plan grows with their number, not with its square.
    """
    members = buckets.select(F.filter("rows", lambda r: forest.leaves_out(t, r[forest.key], r["weight"])).alias("oob"))
    size = F.size("oob")
    hashes = F.array(*[F.xxhash64(F.lit(f"{forest.seed}|{t}|{j}")) for j in range(len(forest.features))])

    def copies(r, i):
        def moved(h, j):
            place = F.lit(1) + F.pmod(h, F.greatest(size - 1, F.lit(1))).cast("int")
            other = F.element_at("oob", F.pmod(i + place, size) + 1)["x"]
            return F.struct(j.alias("j"), r["label"].alias("label"), F.transform(r["x"], lambda v, k: F.when(k == j, F.get(other, k)).otherwise(v)).alias("x"))
        plain = F.struct(F.lit(-1).alias("j"), r["label"].alias("label"), r["x"].alias("x"))
        return F.concat(F.array(plain), F.transform(hashes, moved))

    return members.select(F.explode(F.flatten(F.transform("oob", copies))).alias("c")).select("c.j", "c.label", "c.x")


def oob_importance(forest: BaggedForest, train: DataFrame, bucket_rows: int = 1000) -> DataFrame:
    """(feature, importance): per tree, the rise of the squared error of its own out-of-bag rows when the
    feature's values change places among these; averaged over the trees that have such rows.

    Values move within buckets of ``bucket_rows`` rows in a random order, each tree and feature by its own number of
    places (1 to size - 1), so every value leaves its row.  Buckets are gathered once; a task scores the copies of
    ``oob_copies`` for all its trees, on the rows' bins, and keeps a sum per tree and feature.
    """
    spark, buckets, m, trees = train.sparkSession, gathered(train, forest, bucket_rows), len(forest.features), len(forest.trees)
    codes = spark.sparkContext.broadcast([(t.code, t.prob) for t in forest.trees])
    tree, feature = F.col("id").cast("string"), F.sequence(F.lit(0), F.lit(m - 1))
    hashes = spark.range(1, trees + 1).select("id", F.transform(feature, lambda j: F.xxhash64(F.concat(F.lit(f"{forest.seed}|"), tree, F.lit("|"), j.cast("string")))).alias("h"))
    places = np.array([r["h"] for r in sorted(hashes.collect(), key=lambda r: r["id"])], np.int64)  # as those of ``oob_copies``
    splits, seed = forest.splits, forest.seed

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n = np.zeros((trees, m + 1)), np.zeros((trees, m + 1), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                label, h, rate, x = (batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("label", "h", "rate", "x"))
                bags, bins = Bags(h.view(np.uint64), rate, seed), binned(x.reshape(-1, m), splits)
                for t in range(batch["first"][i].as_py(), batch["last"][i].as_py() + 1):
                    out = bags.left_out(t)
                    own, y, size = bins[out], label[out], int(out.sum())
                    if not size:
                        continue
                    copies = np.broadcast_to(own, (m + 1, size, m)).copy()  # as they are, then one feature moved in each
                    for j in range(m):
                        copies[j + 1, :, j] = np.roll(own[:, j], -(1 + int(places[t - 1, j]) % max(size - 1, 1)))
                    code, prob = codes.value[t - 1]
                    loss[t - 1] += ((prob[leaves(code, copies.reshape(-1, m))].reshape(m + 1, size) - y) ** 2).sum(axis=1)
                    n[t - 1] += size
        t, j = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in ((t + 1).astype(np.int32), (j - 1).astype(np.int32), loss[t, j], n[t, j])], names=["tree", "j", "loss", "n"])

    # few buckets are dealt to more tasks, each with some of the trees
    tasks = 3 * spark.sparkContext.defaultParallelism
    found = buckets.count()
    step = max(1, math.ceil(trees / max(1, math.ceil(tasks / max(found, 1)))))
    pieces = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(min(a + step - 1, trees)).alias("last")) for a in range(1, trees + 1, step)])
    rows = buckets.select(F.transform("rows", lambda r: r["label"].cast("double")).alias("label"), F.transform("rows", lambda r: F.xxhash64(r[forest.key].cast("string"))).alias("h"),
                          F.transform("rows", lambda r: forest.rate(r["weight"])).alias("rate"), F.flatten(F.transform("rows", lambda r: r["x"])).alias("x"), F.inline(pieces))
    sums = rows.repartition(max(1, min(tasks, found * len(range(1, trees + 1, step))))).mapInArrow(losses, "tree int, j int, loss double, n long")
    sums = [tuple(r) for r in sums.groupBy("tree", "j").agg(F.sum("loss"), F.sum("n")).collect()]  # trees x (features + 1) numbers
    base = {t: loss / n for t, j, loss, n in sums if j == -1}
    rise = [[loss / n - base[t] for t, j, loss, n in sums if j == k] for k in range(m)]
    return spark.createDataFrame([(f, sum(r) / len(r) if r else None) for f, r in zip(forest.features, rise)], "feature string, importance double")
