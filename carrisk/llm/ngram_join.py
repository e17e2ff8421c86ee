"""Operator 12: Jaccard self-join of word n-gram sets by rare-first prefix filtering.

Words are runs of non-blank bytes, A-Z in lower case; a text's set holds its
distinct runs of ``N`` words (a shorter text is one run).  Two sets of x and y
n-grams link if ``100 * common >= 90 * union``; then they differ in at most
``(x + y) / 19`` n-grams.

* One order of all n-grams puts rare ones first: by the number of occurrences
  that fall into an n-gram's counter (``COUNTERS`` counters by hash, filled from
  every text and summed over all tasks), then by hash.  Any order gives the same
  links; a rare-first one keeps buckets small.
* A set of x n-grams is entered under its first ``x - ceil(0.9 x) + 1``: linked
  sets share one of these.  Equal sets are one node, named by their digest.
* A pair of a bucket passes the length filter (0.9 of the longer), the positional
  filter (what can still be common behind the shared n-gram) and the suffix
  filter: n-grams counted in ``PARTS`` parts by hash, whose differences add up to
  no more than the n-grams in which two sets differ.  What passes is verified on
  the sets themselves, once per pair.

Buckets of up to ``SMALL`` nodes are joined into distinct pairs.  Larger ones are
settled inside tasks and never become pairs: nodes go with their sets into blocks
of ``BLOCK`` n-grams, a block's links are found there with a running component
label, so that only pairs still apart are verified, and only links that join two
labels leave the task.  First each node goes into the blocks of its largest
bucket only.  Then, in buckets that still hold several components, the nodes
outside the largest one meet all others, block by block; a pair is verified in
the bucket of its first common n-gram.  No bucket is capped or lies in one task.

Defined cases: a null or blank text has an empty set, is linked with nothing and
its component is its own id; rows with equal ids are rows of their own; a null id
links like any other but names no component (null if no other id is in it); an
empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.llm.common import query, ship, table, text_slices, written
from carrisk.llm.components import connected_components
from carrisk.llm.near_dedup import _hash_filter

N = 3
COUNTERS, COUNTER_ROWS = 1 << 22, 64
PARTS, SMALL, BLOCK = 128, 32, 1 << 20
MAX_WORDS = 1 << 20  # words a worker remembers before it starts anew (cost only)
FAN_IN = 64  # counter tables that one task adds up
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_sets(texts: list[str | None], hashes: WordHashes, n: int = N) -> list:
    """The distinct n-grams of each text as sorted 64-bit hashes."""
    import numpy as np

    if len(hashes) > MAX_WORDS:
        hashes.clear()
    words = [(t or "").encode().translate(LOWER).split() for t in texts]  # bytes.split: blank, 9 to 13
    sizes = [len(w) for w in words]
    flat = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, sum(sizes))
    odd = np.uint64(0x9E3779B97F4A7C15)
    gram = np.zeros(max(len(flat) - n + 1, 0), np.uint64)
    for j in range(n):
        gram = _mix(gram * odd + flat[j:len(gram) + j] + np.uint64(j + 1))
    out, first = [], 0
    for size in sizes:
        if size >= n:
            out.append(np.unique(gram[first:first + size - n + 1]))
        elif size:
            short = np.full(1, 1 << 40 | size, np.uint64)
            for j in range(size):
                short = _mix(short * odd + flat[first + j:first + j + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        first += size
    return out


def prefix_length(n: int) -> int:
    return n - -(-9 * n // 10) + 1 if n else 0


def most_apart(x, y):
    """In how many n-grams linked sets of these sizes can differ."""
    return (x + y) // 19


def common(a, b) -> int:
    """Number of common members of two sorted arrays."""
    import numpy as np

    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def part_counts(grams):
    """N-grams by part, up to 255 in each."""
    import numpy as np

    return np.minimum(np.bincount((grams >> np.uint64(57)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8)


def digest(grams) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def saturated(a, b):
    """a + b of 32-bit counters, which stop at their largest value (the order needs no more)."""
    import numpy as np

    return np.minimum(a.astype(np.int64) + b, np.iinfo(np.int32).max).astype(np.int32)


# ---------------------------------------------------------------- passes over the texts
def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def digests_and_counts(docs: DataFrame) -> DataFrame:
    """(id, node, n) of each row, and (part, row, counts): a task's counters, compressed, in ``COUNTER_ROWS`` rows."""
    names = ["id", "node", "n", "part", "row", "counts"]
    kind = docs.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, size = to_arrow_type(docs.schema["id"].dataType), COUNTERS

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        hashes, counts, seen = WordHashes(), np.zeros(size, np.int32), False
        for part in text_slices(batches, "text"):
            sets = gram_sets(part.column(1).to_pylist(), hashes)
            grams = np.concatenate(sets)
            np.add.at(counts, (grams % np.uint64(size)).astype(np.int64), 1)  # a task's part of a table holds fewer than 2^31 words
            seen, m = True, part.num_rows
            yield pa.RecordBatch.from_arrays([part.column(0).cast(id_type), pa.array([digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if seen:
            m = COUNTER_ROWS
            data = [pa.compress(c.tobytes(), "zstd", asbytes=True) for c in counts.reshape(m, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(m, id_type), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()),
                                              pa.array([TaskContext.get().partitionId()] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array(data, pa.binary())], names=names)

    return docs.mapInArrow(run, f"id {kind}, node binary, n long, part long, row int, counts binary")


def total_counts(counters: DataFrame):
    """The counters of all tasks, added up ``FAN_IN`` at a time: [COUNTERS] (fixed size, whatever the input)."""
    import numpy as np

    size = COUNTERS // COUNTER_ROWS * 4

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(size // 4, np.int32)
        for c in group["counts"].to_pylist():
            total = saturated(total, np.frombuffer(pa.decompress(c, size, "zstd", asbytes=True), np.int32))
        return pa.table({"part": pa.array([group["part"][0].as_py()], pa.int64()), "row": group["row"].slice(0, 1),
                         "counts": pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())})

    parts = (counters.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        counters = (counters.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("row", "part").applyInArrow(add, "part long, row int, counts binary"))
        parts = -(-parts // FAN_IN)
        if parts > 1:
            counters = written(counters, "gram-counts")
    total = np.zeros((COUNTER_ROWS, COUNTERS // COUNTER_ROWS), np.int32)
    for r in counters.select("row", "counts").collect():
        total[r["row"]] = np.frombuffer(pa.decompress(bytes(r["counts"]), size, "zstd", asbytes=True), np.int32)
    return total.reshape(-1)


def rare_first(grams, counts):
    """A set's n-grams in the common order."""
    import numpy as np

    return grams[np.lexsort((grams, counts[(grams % np.uint64(len(counts))).astype(np.int64)]))]


def prefixes(docs: DataFrame, counts) -> DataFrame:
    """(node, n, parts, grams): the prefix of each non-empty set, in order."""
    names = ["node", "n", "parts", "grams"]
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        import numpy as np

        hashes = WordHashes()
        for part in text_slices(batches, "text"):
            sets = [s for s in gram_sets(part.column(1).to_pylist(), hashes) if len(s)]
            firsts = [rare_first(s, shared.value)[:prefix_length(len(s))] for s in sets]
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            flat = np.concatenate(firsts).view(np.int64) if firsts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([part_counts(s).tobytes() for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=names)

    return docs.mapInArrow(run, "node binary, n long, parts binary, grams array<long>")


def wanted_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, grams): the sorted n-grams of the nodes ``wanted``; only texts whose id may be theirs are read again."""
    texts = _hash_filter(docs, nodes.join(wanted, "node", "left_semi").select("id"), "id")
    names = ["node", "grams"]

    def run(batches):
        hashes = WordHashes()
        for part in text_slices(batches, "text"):
            sets = gram_sets(part.column(1).to_pylist(), hashes)
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=names)

    found = texts.mapInArrow(run, "node binary, grams binary").join(wanted, "node", "left_semi")
    return found.groupBy("node").agg(F.first("grams").alias("grams"))


# ---------------------------------------------------------------- small buckets: distinct pairs
def candidate_pairs(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """Distinct (src, dst) of the buckets' rows (gram, place, node, n) that length, position and suffix (by ``parts``) let link."""
    x = entries.select("gram", *[F.col(c).alias(f"{c}_a") for c in ("place", "node", "n")])
    y = entries.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("place", "node", "n")])
    pairs = x.join(y, "gram").where("node_a < node_b")
    pairs = pairs.where("10 * least(n_a, n_b) >= 9 * greatest(n_a, n_b)")
    # n-grams before the shared one that can be common, itself, and those behind it
    most = "least(place_a, place_b) + 1 + least(n_a - place_a, n_b - place_b) - 1"
    pairs = pairs.where(f"n_a + n_b - 2 * ({most}) <= (n_a + n_b) div 19")
    pairs = pairs.groupBy("node_a", "node_b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    for c in "ab":
        pairs = pairs.join(parts.select(F.col("node").alias(f"node_{c}"), F.col("parts").alias(f"parts_{c}")), f"node_{c}")

    def run(batches):
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16) for c in ("parts_a", "parts_b"))
            near = np.abs(x - y).sum(1) <= most_apart(*(batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b")))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("node_a", "node_b")], names=["src", "dst"])

    return pairs.mapInArrow(run, "src binary, dst binary")


def verified_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (src, dst) among ``pairs``."""
    both = (pairs.join(sets.select(F.col("node").alias("src"), F.col("grams").alias("a")), "src")
            .join(sets.select(F.col("node").alias("dst"), F.col("grams").alias("b")), "dst").select("src", "dst", "a", "b"))

    def run(batches):
        import numpy as np

        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                keep.append(len(a) + len(b) - 2 * common(a, b) <= most_apart(len(a), len(b)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["src", "dst"])

    return both.mapInArrow(run, "src binary, dst binary")


# ---------------------------------------------------------------- large buckets: settled inside tasks
def links_between(gram: int | None, nodes: list, label, n, parts, grams: list, prefix: list, seeks, others) -> list[tuple]:
    """Links between seekers and others that join two labels (changed in place).

    With ``gram``, a pair is verified only if that is the first n-gram that its prefixes share (another bucket has the rest).
    """
    import numpy as np

    links = []
    other_n, other_parts = n[others], parts[others]
    for i in seeks.tolist():
        near = np.flatnonzero((10 * np.minimum(other_n, n[i]) >= 9 * np.maximum(other_n, n[i])) & (label[others] != label[i]))
        gap = np.abs(other_parts[near] - parts[i]).sum(1)
        fits = gap <= most_apart(other_n[near], n[i])
        near = near[fits][np.argsort(gap[fits], kind="stable")]  # the likeliest first
        for j in others[near].tolist():
            if label[j] == label[i]:
                continue
            if gram is not None and first_common(prefix[i], prefix[j]) != gram:
                continue
            if n[i] + n[j] - 2 * common(grams[i], grams[j]) <= most_apart(n[i], n[j]):
                links.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
    return links


def first_common(a, b):
    """The first member of ``a`` that ``b`` holds (both in the common order), or None."""
    import numpy as np

    hit = np.isin(a, b)
    return int(a[hit.argmax()]) if hit.any() else None


def settled(rows: DataFrame, sets: DataFrame, once: bool) -> DataFrame:
    """Links (src, dst) found in blocks: rows (gram, low, high, node, component, seeks, n, prefix)."""
    with_sets = rows.join(sets, "node")

    def run(group: pa.Table) -> pa.Table:
        import numpy as np

        nodes = group["node"].to_pylist()
        codes: dict[bytes, int] = {}
        label = np.array([codes.setdefault(c, len(codes)) for c in group["component"].to_pylist()])
        grams = [np.frombuffer(g, np.uint64) for g in group["grams"].to_pylist()]
        parts = np.array([part_counts(g) for g in grams], np.int16).reshape(-1, PARTS)
        prefix = [np.array(p, np.int64) for p in group["prefix"].to_pylist()] if once else []
        seeks = np.array(group["seeks"].to_pylist(), bool)
        both = not once  # a block of the first round: every row meets the others
        links = links_between(group["gram"][0].as_py() if once else None, nodes, label, group["n"].to_numpy().astype(np.int64), parts, grams, prefix,
                              np.arange(len(nodes)) if both else np.flatnonzero(seeks), np.arange(len(nodes)) if both else np.flatnonzero(~seeks))
        src, dst = zip(*links) if links else ((), ())
        return pa.table({"src": pa.array(src, pa.binary()), "dst": pa.array(dst, pa.binary())})

    return with_sets.groupBy("gram", "low", "high").applyInArrow(run, "src binary, dst binary")


def first_blocks(entries: DataFrame) -> DataFrame:
    """Rows for ``settled``: each node in a block of its largest bucket."""
    own = entries.groupBy("node").agg(F.max(F.struct("size", "gram")).alias("own")).select("node", F.col("own.gram").alias("gram"))
    rows = entries.join(own, ["node", "gram"], "left_semi")
    blocks = rows.groupBy("gram").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return (rows.join(blocks, "gram").withColumn("low", block)
            .select("gram", "low", F.col("low").alias("high"), "node", F.col("node").alias("component"), F.lit(True).alias("seeks"), "n"))


def other_blocks(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows for ``settled``: in buckets of several components, the nodes outside the largest one meet all others."""
    rows = entries.join(parts.withColumnRenamed("component", "c"), "node", "left").withColumn("component", F.coalesce("c", "node")).drop("c")
    sums = rows.groupBy("gram", "component").agg(F.sum("n").alias("n"))
    size = (sums.groupBy("gram").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("total"), F.max("n").alias("most"))
            .where("total > most").select("gram", "largest", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"),
                                          F.ceil((F.col("total") - F.col("most")) / BLOCK).cast("int").alias("rare_blocks")))
    rows = rows.join(size, "gram").withColumn("rare", F.col("component") != F.col("largest")).withColumn("hash", F.xxhash64("node"))
    columns = ["gram", "low", "high", "node", "component", "seeks", "n"]
    met = rows.withColumns({"low": F.explode(F.sequence(F.lit(0), F.col("rare_blocks") - 1)), "high": F.pmod("hash", "blocks").cast("int"), "seeks": F.lit(False)})
    seeking = rows.where("rare").withColumns({"high": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "low": F.pmod("hash", "rare_blocks").cast("int"), "seeks": F.lit(True)})
    return met.select(*columns).unionByName(seeking.select(*columns))


# ---------------------------------------------------------------- the join
def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, n_shingles, component_id)."""
    spark = docs.sparkSession
    ship(spark)
    source = _source(docs, id_col, text_col)
    read = written(digests_and_counts(source), "gram-digests")
    rows = read.where("node is not null").select("id", "node", "n")
    counts = total_counts(read.where("node is null").select("part", "row", "counts"))
    full = rows.where("n > 0")
    nodes = written(full.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n")), "gram-nodes")
    prefix = prefixes(source, counts).groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "parts", "grams")])
    prefix = written(prefix, "gram-prefixes")
    entries = prefix.select("node", F.col("n").cast("int").alias("n"), F.posexplode("grams").alias("place", "gram"))
    buckets = written(entries.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "gram-buckets")
    shared = written(entries.join(buckets, "gram"), "gram-entries")
    small, large = shared.where(f"size <= {SMALL}"), shared.where(f"size > {SMALL}")
    pairs = written(candidate_pairs(small, prefix), "gram-pairs")
    ends = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).unionByName(large.select("node"))
    wanted = written(ends.distinct(), "gram-wanted")
    sets = written(wanted_sets(source, nodes, wanted), "gram-sets")
    links = verified_pairs(pairs, sets)
    links = written(links.unionByName(settled(first_blocks(large).withColumn("prefix", F.lit(None).cast("array<long>")), sets, once=False)), "gram-links")
    parts = written(connected_components(links), "gram-components")
    left = written(other_blocks(large, parts), "gram-left")
    if not left.isEmpty():
        more = settled(left.join(prefix.select("node", F.col("grams").alias("prefix")), "node"), sets, once=True)
        more = written(more, "gram-links")
        if not more.isEmpty():
            parts = written(connected_components(links.unionByName(more)), "gram-components")
    named = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    names = written(named.join(least, "component").select("node", "least"), "gram-names")
    out = rows.join(names, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def _sql() -> str:
    return r"""with recursive words as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w from documents),
      grams as materialized (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g from words),
      sizes as (select doc_id, coalesce(len(g), 0) as n from grams),
      flat as materialized (select doc_id, unnest(g) as t from grams),
      often as materialized (select t from flat group by t having count(*) > 1),
      near as materialized (select a.doc_id as x, b.doc_id as y, count(*) as c from flat a join flat b on a.t = b.t and a.doc_id < b.doc_id where a.t in (select t from often) group by 1, 2),
      links as materialized (select x, y from near join sizes p on x = p.doc_id join sizes q on y = q.doc_id where 100 * c >= 90 * (p.n + q.n - c)),
      ends as (select x, y from links union all select y, x from links),
      reach(a, b) as (select doc_id, doc_id from sizes union select r.a, e.y from reach r join ends e on r.b = e.x)
      select s.doc_id, cast(s.n as bigint) as n_shingles, min(r.b) as component_id from sizes s join reach r on s.doc_id = r.a group by 1, 2"""


@query("op12_ngram_jaccard", _sql())
def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
