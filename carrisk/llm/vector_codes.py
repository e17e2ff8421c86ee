"""Operator 13: vector code compression with Drake-Hamerly adaptive bounds.

A vector's components become integers floor(256 x); it is cut into ``PARTS``
consecutive parts, each coded by the nearest of its position's ``ENTRIES``
codebook entries (squared Euclidean distance, ties to the lower index).

Bounds: a pass over the vectors persists, for each part, its ``b`` closest
entries in order, a lower bound on the distance to each, and one outer bound
on the distance to all others (Drake and Hamerly 2012).  When entries move,
a tracked bound falls by its own entry's move, the outer bound by the largest
one.  In the next pass the part's present entry is measured exactly; a tracked
entry is looked at only if its bound does not exceed that distance, and all
entries are measured only if the outer bound does not.  Bounds only tell what
can be left out: every distance that decides is an exact integer, so results
equal those of a full search, ties included.  ``b`` adapts within each batch:
to the place that ``COVER`` of its parts needed, twice as many where over a
tenth of them needed all entries, between ``LEAST`` and ``MOST``.

Spark: a pass is one ``mapInArrow`` whose rows are the parts' state and, at a
task's end, its sums by (position, entry); both go to one table in the shared
folder.  Sums meet in a groupBy; codebooks (``ENTRIES`` times the components
of a vector, whatever the input) are the only thing that reaches the driver.
Bounds are kept as 16-bit floats cut downward, integers in the smallest type
of their batch.

Defined cases: rows whose vector is null or has a null, infinite or NaN
component are dropped, and so are those whose length differs from the first
kept row's and those with a component of 2^54 or more in size, as no integer
of 64 bits holds 256 times it; fewer than 64 kept rows make as many entries;
a length that 16 does not divide gives parts whose lengths differ by one;
rows with equal ids are rows of their own, in the order of their vectors;
null ids come after all others; an empty table gives no rows; an error beyond
a long is null; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.llm.common import query, ship, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
FIRST, LEAST, MOST, COVER = 8, 4, 16, 0.95
LIMIT = 1 << 54
SMALL_LABELS = 100_000  # label sums that are broadcast; beyond, a salted join
SALTS = 32

STATE = "id {id}, label {label}, b int, kind int, ints binary, entries binary, bounds binary, part int, entry int, n long, sums array<string>"


def cuts(dims: int) -> list[int]:
    return [p * dims // PARTS for p in range(PARTS + 1)]


def distances(x, book):
    """Exact squared distances [rows, entries] as int64, or Python integers where those could overflow."""
    import numpy as np

    size = float(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    most = 4 * size * size * max(x.shape[1], 1)
    if most < 2 ** 52:  # every step is an integer below 2^53: exact in doubles, and a matrix product
        a, c = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    kind = np.int64 if most < 2 ** 62 else object
    gap = x.astype(kind)[:, None, :] - book.astype(kind)[None, :, :]
    return (gap * gap).sum(2)


def own_distances(x, entries):
    """Exact squared distances of rows to one entry each."""
    import numpy as np

    size = float(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.int64 if 4 * size * size * max(x.shape[1], 1) < 2 ** 62 else object
    gap = x.astype(kind) - entries.astype(kind)
    return (gap * gap).sum(1) if gap.shape[1] else np.zeros(len(x), np.int64)


def root(d, up: bool):
    """Square roots that are not too small (``up``) or not too large."""
    import numpy as np

    value = np.sqrt(d.astype(np.float64))
    return np.nextafter(value * (1 + 2e-16), np.inf) if up else np.maximum(np.nextafter(value * (1 - 2e-16), 0), 0)


def packed(bounds):
    """16-bit floats, cut downward (the upper half of a positive float32)."""
    import numpy as np

    low = np.maximum(bounds, 0).astype(np.float32)
    low = np.where(low > bounds, np.nextafter(low, np.float32(0)), low)
    return (low.view(np.uint32) >> np.uint32(16)).astype(np.uint16)


def unpacked(packed_bounds):
    import numpy as np

    return (packed_bounds.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.float64)


def full_search(x, book, b: int):
    """(entry, distance, tracked [n, b], bounds [n, b + 1]) from all distances; the last bound is the outer one."""
    import numpy as np

    d = distances(x, book)
    order = np.argsort(d, axis=1, kind="stable")[:, :b + 1]  # ties: lower index first
    ordered = np.take_along_axis(d, order, 1)
    tracked, bounds = order[:, :b], root(ordered, up=False)
    if bounds.shape[1] <= b:  # every entry is tracked: nothing lies outside
        missing = b + 1 - bounds.shape[1]
        bounds = np.concatenate([bounds, np.full((len(x), missing), np.inf)], 1)
        tracked = np.concatenate([tracked, np.repeat(order[:, :1], b - tracked.shape[1], 1)], 1) if tracked.shape[1] < b else tracked
    return order[:, 0], ordered[:, 0], tracked, bounds


def bounded_search(x, book, moves, tracked, bounds):
    """The same from a part's state before its entries moved, and (searched, place): whether all entries were
    measured, and the last place among the tracked ones that was."""
    import numpy as np

    n, b = tracked.shape
    lower = bounds[:, :b] - moves[tracked]
    outer = bounds[:, b] - moves.max(initial=0.0)
    lower, outer = (np.where(v > 0, v * (1 - 1e-9), v * (1 + 1e-9)) for v in (lower, outer))
    best = tracked[:, 0].copy()
    distance = own_distances(x, book[best])
    lower[:, 0] = root(distance, up=False)
    upper = root(distance, up=True)
    searched = outer <= upper
    place = np.zeros(n, np.int64)
    for j in range(1, b):
        at = np.flatnonzero(~searched & (lower[:, j] <= upper) & (tracked[:, j] != tracked[:, 0]))
        if not len(at):
            continue
        entry = tracked[at, j]
        d = own_distances(x[at], book[entry])
        lower[at, j] = root(d, up=False)
        place[at] = j
        wins = (d < distance[at]) | (d == distance[at]) & (entry < best[at])
        won = at[wins]
        best[won], distance[won], upper[won] = entry[wins], d[wins], root(d[wins], up=True)
    # the new order: the nearest first, then by bound
    key = np.where(tracked == best[:, None], -1.0, lower)
    order = np.argsort(key, axis=1, kind="stable")
    tracked = np.take_along_axis(tracked, order, 1)
    bounds = np.concatenate([np.take_along_axis(lower, order, 1), outer[:, None]], 1)
    at = np.flatnonzero(searched)
    if len(at):
        best[at], distance[at], tracked[at], bounds[at] = full_search(x[at], book, b)
    return best, distance, tracked, bounds, searched, place


def resized(tracked, bounds, b: int):
    """State with ``b`` tracked entries; bounds of those let go sink into the outer one (more: the last is repeated)."""
    import numpy as np

    old = tracked.shape[1]
    if b < old:
        outer = np.minimum(bounds[:, b:old].min(1), bounds[:, old])
        return tracked[:, :b], np.concatenate([bounds[:, :b], outer[:, None]], 1)
    if b > old:  # places without an entry of their own repeat the nearest one; a full search fills them
        more = np.repeat(tracked[:, :1], b - old, 1)
        return np.concatenate([tracked, more], 1), np.concatenate([bounds[:, :old], np.full((len(bounds), b - old), np.inf), bounds[:, old:]], 1)
    return tracked, bounds


def adapted(b: int, searched, place) -> int:
    """The ``b`` for the next pass, from what a batch's parts needed in this one."""
    import numpy as np

    if searched.mean() > 0.1:
        return min(2 * b, MOST)
    needed = np.sort(place[~searched])
    return int(min(max(needed[int(COVER * (len(needed) - 1))] + 2, LEAST), MOST))


def fixed_binary(rows) -> pa.Array:
    """Rows of equal width as a binary array without copies by row."""
    import numpy as np

    rows = np.ascontiguousarray(rows)
    width = rows.nbytes // max(len(rows), 1)
    offsets = (np.arange(len(rows) + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def smallest(ints):
    """The integers in the smallest signed type that holds them."""
    import numpy as np

    low, high = int(ints.min(initial=0)), int(ints.max(initial=0))
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return ints.astype(kind)
    return ints.astype(np.int64)


def integers(column: pa.Array, dims: int):
    """floor(256 x) of equally long vectors [rows, dims] as int64."""
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * SCALE).astype(np.int64).reshape(len(column), dims)


def slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most about four million integers, so a task's memory follows neither its partition nor the vectors' length."""
    rows = max(1, (1 << 22) // max(width, 1))
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


class Sums:
    """A task's sums by position and entry."""

    def __init__(self, books, dims: int) -> None:
        import numpy as np

        self.at, self.k = cuts(dims), len(books[0])
        self.n = np.zeros((PARTS, self.k), np.int64)
        self.total = np.zeros((self.k, dims), object)  # Python integers: no sum overflows

    def add(self, p: int, x, best) -> None:
        import numpy as np

        self.n[p] += np.bincount(best, minlength=self.k)
        high = float(np.abs(x).max(initial=0)) * max(len(x), 1)
        order = np.argsort(best, kind="stable")
        at, first = np.unique(best[order], return_index=True)
        if len(at) and x.shape[1]:
            part = np.add.reduceat(x[order].astype(np.int64 if high < 2 ** 62 else object), first, axis=0)
            self.total[at, self.at[p]:self.at[p + 1]] += part

    def rows(self) -> list[tuple]:
        found = []
        for p in range(PARTS):
            for e in self.n[p].nonzero()[0].tolist():
                found.append((p, e, int(self.n[p][e]), [str(v) for v in self.total[e, self.at[p]:self.at[p + 1]]]))
        return found


def _pass(dims: int, books: list, moves: list | None, last: bool, names: list[str], schema: pa.Schema):
    """The ``mapInArrow`` function of a pass: the first (vectors; ``moves`` None) or a later one (states); the last gives codes."""
    at = cuts(dims)

    def run(batches):
        import numpy as np

        sums, b = Sums(books, dims), FIRST
        for batch in slices(batches, dims + 100 * PARTS):
            n = batch.num_rows
            if moves is None:
                ints = integers(batch.column("vector"), dims)
            else:
                ints = stored_integers(batch.column("ints"), dims)
            small = smallest(ints)
            best, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, object if np.abs(ints).max(initial=0) > 1 << 24 else np.int64)
            groups = [(np.arange(n), FIRST)] if moves is None else [(np.flatnonzero(bs == v), int(v)) for bs in [batch.column("b").to_numpy()] for v in np.unique(bs)]
            out_b = np.zeros(n, np.int32)
            entries_out, bounds_out = [b""] * n, [b""] * n
            for rows, width in groups:
                state, searched, place = [], [], []
                if moves is not None:
                    old = np.frombuffer(b"".join(batch.column("entries").take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), PARTS, width)
                    old_bounds = unpacked(np.frombuffer(b"".join(batch.column("bounds").take(pa.array(rows)).to_pylist()), np.uint16)).reshape(len(rows), PARTS, width + 1)
                for p in range(PARTS):
                    x = ints[rows, at[p]:at[p + 1]]
                    if moves is None:
                        a, d, tracked, bounds = full_search(x, books[p], width)
                    else:
                        a, d, tracked, bounds, all_of, until = bounded_search(x, books[p], moves[p], old[:, p].astype(np.int64), old_bounds[:, p])
                        searched.append(all_of)
                        place.append(until)
                    best[rows, p] = a
                    error[rows] += d
                    state.append((tracked, bounds))
                if last:
                    continue
                b = width if moves is None else adapted(width, np.concatenate(searched), np.concatenate(place))
                state = [resized(t, l, b) for t, l in state]
                tracked = np.stack([t for t, _ in state], 1).astype(np.uint8).reshape(len(rows), -1)
                bounds = packed(np.stack([l for _, l in state], 1)).reshape(len(rows), -1)
                out_b[rows] = b
                for i, t, l in zip(rows.tolist(), tracked, bounds):
                    entries_out[i], bounds_out[i] = t.tobytes(), l.tobytes()
            if last:
                codes = [c.tobytes().hex() for c in best]
                fits = [int(e) if int(e) < 2 ** 63 else None for e in error]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(fits, pa.int64())], names=names)
                continue
            for p in range(PARTS):
                sums.add(p, ints[:, at[p]:at[p + 1]], best[:, p].astype(np.int64))
            empty = [pa.nulls(n, schema.field(c).type) for c in ("part", "entry", "n", "sums")]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(schema.field("id").type), batch.column("label").cast(schema.field("label").type), pa.array(out_b),
                                              pa.array(np.zeros(n, np.int32)), fixed_binary(small), pa.array(entries_out, pa.binary()), pa.array(bounds_out, pa.binary()), *empty], schema=schema)
        rows = sums.rows()
        if rows and not last:
            part, entry, count, total = zip(*rows)
            m = len(rows)
            nothing = [pa.nulls(m, schema.field(c).type) for c in ("id", "label", "b")]
            binary = [pa.nulls(m, pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([1] * m, pa.int32()), *binary, pa.array(part, pa.int32()), pa.array(entry, pa.int32()),
                                              pa.array(count, pa.int64()), pa.array(total, pa.list_(pa.string()))], schema=schema)

    return run


def stored_integers(column: pa.Array, dims: int):
    """Vectors of one batch as int64; a row's bytes tell the type it was stored in."""
    import numpy as np

    if not dims:
        return np.zeros((len(column), 0), np.int64)
    import pyarrow.compute as pc

    widths = (pc.binary_length(column).to_numpy(zero_copy_only=False) // dims).astype(np.int64)
    out = np.zeros((len(column), dims), np.int64)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        out[rows] = np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), f"<i{w}").reshape(-1, dims)
    return out


def moved(books: list, sums: DataFrame) -> list:
    """Codebooks after a round: floor(sum / count) of each entry's parts; entries without any stay."""
    import numpy as np

    value = F.posexplode("sums").alias("at", "value")
    totals = (sums.select("part", "entry", "n", value).groupBy("part", "entry", "at")
              .agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect())  # ENTRIES x components of a vector
    new = [b.copy() for b in books]
    for r in totals:
        new[r.part][r.entry, r["at"]] = int(r.total) // r.n
    return [np.asarray(b) for b in new]


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector) of the rows whose vector has finite components only."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LIMIT))))


def with_label_errors(codes: DataFrame, small_labels: int = SMALL_LABELS) -> DataFrame:
    """``codes`` + label_error: the sum of error over rows of its label, nulls together."""
    total = F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error")
    sums = written(codes.groupBy("label").agg(total), "label-errors")
    if sums.count() <= small_labels:
        sums = F.broadcast(sums.withColumnRenamed("label", "__label"))
        return codes.join(sums, codes["label"].eqNullSafe(sums["__label"])).drop("__label")
    salted = codes.withColumn("__salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
    sums = sums.select(F.col("label").alias("__label"), "label_error", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__s"))
    return salted.join(sums, (F.col("__salt") == F.col("__s")) & F.col("label").eqNullSafe(F.col("__label"))).drop("__salt", "__s", "__label")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: (id_col, label, code, error, label_error, codebooks_sha256)."""
    import numpy as np

    spark = vectors.sparkSession
    ship(spark)
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    seeds = [r.vector for r in kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()]
    dims = len(seeds[0]) if seeds else 0
    kept = kept.where(F.size("vector") == dims)
    seeds = [s for s in seeds if len(s) == dims]
    if seeds and any(len(s) != dims for s in seeds) or len(seeds) < ENTRIES:
        seeds = [r.vector for r in kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()]
    first = np.floor(np.array(seeds, np.float64).reshape(len(seeds), dims) * SCALE).astype(np.int64)
    at = cuts(dims)
    books = [first[:, at[p]:at[p + 1]] for p in range(PARTS)]
    kinds = {f: kept.schema[f].dataType for f in ("id", "label")}
    ddl = STATE.format(**{k: t.simpleString() for k, t in kinds.items()})
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))
    schema = pa.schema([schema.field(n).with_nullable(True) for n in schema.names])
    rows, moves = kept, None
    for _ in range(rounds if seeds else 0):
        state = written(rows.mapInArrow(_pass(dims, books, moves, False, schema.names, schema), ddl), "vector-states")
        new = moved(books, state.where("kind = 1").select("part", "entry", "n", "sums"))
        moves = [root(own_distances(n, o), up=True) for n, o in zip(new, books)]
        books, rows = new, state.where("kind = 0").select("id", "label", "b", "ints", "entries", "bounds")
    names = ["id", "label", "code", "error"]
    codes = written(rows.mapInArrow(_pass(dims, books, moves, True, names, schema),
                                    f"id {kinds['id'].simpleString()}, label {kinds['label'].simpleString()}, code string, error long"), "vector-codes")
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()
    out = with_label_errors(codes).withColumn("codebooks_sha256", F.lit(digest))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The contract in DuckDB: all distances in every round."""
    def nearest(r: int) -> str:
        return f"""a{r} as materialized (select rid, p, min([d, e]) as best from (select x.rid, x.p, b.e,
          list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from parts x join b{r} b on x.p = b.p) group by rid, p)"""

    def update(r: int) -> str:
        return f"""m{r} as materialized (select p, e, list(cast(floor(cast(s as double) / n) as bigint) order by i) as v from (
          select a.p, a.best[2] as e, u.i, sum(x.v[u.i]) as s, count(*) as n from a{r} a join parts x on a.rid = x.rid and a.p = x.p
          cross join (select unnest(range(1, (select max(len(v)) from parts) + 1)) as i) u group by 1, 2, 3) group by p, e),
        b{r + 1} as materialized (select b.p, b.e, coalesce(m.v, b.v) as v from b{r} b left join m{r} m on b.p = m.p and b.e = m.e)"""

    return f"""with kept as materialized (select row_number() over (order by vec_id, embedding) as rid, vec_id, label,
          list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
          where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        parts as materialized (select rid, p, list_slice(v, p * len(v) // 16 + 1, (p + 1) * len(v) // 16) as v from kept, (select unnest(range(16)) as p)),
        b0 as materialized (select p, rid - 1 as e, v from parts where rid <= 64),
        {nearest(0)}, {update(0)}, {nearest(1)}, {update(1)}, {nearest(2)},
        coded as (select rid, string_agg(printf('%02x', cast(best[2] as int)), '' order by p) as code, cast(sum(best[1]) as bigint) as error from a2 group by rid),
        book as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as h from b2)
        select k.vec_id, k.label, c.code, c.error, cast(sum(c.error) over (partition by k.label) as bigint) as label_error, book.h as codebooks_sha256
        from kept k join coded c on k.rid = c.rid, book"""


@query("op13_vector_codes", _sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))
