"""Operator 5: near-dedup by Order MinHash, verified by banded alignment.

Sketch: the k-mers of a text are its runs of ``K`` (five) words, labelled with
their occurrence number.  Each of ``ENTRIES`` hash functions picks the
``TAKEN`` labelled k-mers of least hash; kept in text order they make one key.
Two texts share a key only if the same k-mers come first and stand in the same
order, so keys follow edit similarity.  Words replaced here and there with edit
similarity s leave s^5 of the k-mers, a k-mer similarity j = s^5 / (2 - s^5), and
a key is shared with probability about j^2: of 64 keys, some one with 0.92 at
s = 0.8, 0.995 at 0.85 and nearly always above.

Links: equal normalised texts (lower case, single blanks) are one
representative.  The hub of a bucket (texts of a key) is its text of least hash;
each text is aligned with the hub that it meets in most buckets, so a group of n
costs n alignments, however many copies it holds.  A link is an edit
similarity over words of ``SIMILARITY`` or more by a bit-parallel alignment in
the band that this allows.  Components of these links, in most buckets one, are
classes.  What these stars leave apart is settled inside the tasks: rows of a
bucket that are not in its largest component meet all rows of other components,
in blocks of ``BLOCK`` rows.  A pair is set aside only where it cannot be a link: an
edit takes away one word of either text at most, so words (counted by hash in
``BAG`` places) that one has and the other lacks must fit in the band; and where
another key, earlier in the sketch, has the pair too.  A first pass over sketches
and counts finds the rows that such pairs leave, a second one gets these rows'
words and aligns, with a running component label: pairs that others have joined
are skipped, and only links that join two labels leave the task.  So two texts that
share a key and are similar are always of one class, no bucket is capped, none
becomes pairs, and none meets in one task.

Copies are grouped by digest with a partial ``min``.  Only the texts of
candidates are shuffled: a bitmap of their hashed ids, of fixed size
(``FILTER_BITS``), is broadcast to the scan, and what passes it by chance goes in
the exact join.  Representatives are numbered when they are written, and all
steps but the first and the last carry these numbers, not ids.  Intermediate
tables are written to the shared folder and removed when the step that needs
them is done.

Defined cases: null and empty texts are copies of each other; a text under
five words is one k-mer, so only its copies join it; rows with equal ids are
one document; a null id is no representative, and its row gets the class of
its copies, if any, else null; an empty table gives no rows; extra columns are
not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.llm.common import query, ship, step, table, text_slices, written
from carrisk.llm.components import connected_components

K, ENTRIES, TAKEN, SIMILARITY = 5, 64, 2, 0.8
BLOCK, BLOCK_WORDS, BAG, FILTER_BITS = 1 << 10, 1 << 20, 256, 1 << 24


def _mix(x):
    """A 64-bit finaliser, in place."""
    import numpy as np

    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: pa.Array):
    """(64-bit hash of every word, its text's number, words per text) of normalised texts."""
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.split_pattern(texts, " ")
    flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    word = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    word, owner = word[coded.indices.to_numpy()][real], owner[real]
    return word, owner, np.bincount(owner, minlength=len(texts))


def word_bags(word, owner, n: int):
    """Bags [n, BAG] as uint8: words by the last bits of their hash, up to 255 of each."""
    import numpy as np

    bags = np.bincount(owner * BAG + (word % np.uint64(BAG)).astype(np.int64), minlength=n * BAG).reshape(n, BAG)
    return np.minimum(bags, 255).astype(np.uint8)


def order_sketches(texts: pa.Array, k: int = K, entries: int = ENTRIES, taken: int = TAKEN):
    """(keys [n, entries] as int64, words per text) of normalised texts."""
    import numpy as np

    n = len(texts)
    word, owner, n_words = word_hashes(texts)
    # k-mers: every run of k words; a shorter text is a single one
    first = np.cumsum(n_words) - n_words
    within = np.arange(len(word)) - first[owner]
    keep = (within <= n_words[owner] - k) | (within == 0) & (n_words[owner] < k)
    at = np.flatnonzero(keep)
    kmer = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = within[at] + j < n_words[owner[at]]
        kmer = _mix(kmer * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, word[np.minimum(at + j, max(len(word) - 1, 0))] if len(word) else 0, np.uint64(j + 1)))
    own = owner[at]
    order = np.lexsort((kmer, own))  # stable: equal k-mers stay in text order
    sorted_kmer, sorted_own = kmer[order], own[order]
    new = np.ones(len(at), bool)
    new[1:] = (sorted_kmer[1:] != sorted_kmer[:-1]) | (sorted_own[1:] != sorted_own[:-1])
    run = np.flatnonzero(new)
    occurrence = np.empty(len(at), np.uint64)
    occurrence[order] = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    label = _mix(kmer + occurrence * np.uint64(0xD6E8FEB86659FD93))
    keys = np.zeros((n, entries), np.int64)
    has = np.flatnonzero(np.bincount(own, minlength=n))
    starts = np.searchsorted(own, has)
    top, bits = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(max(len(own), 1).bit_length())
    place = np.arange(len(own), dtype=np.uint64)  # in the last bits: the least value tells where it stands
    low = (np.uint64(1) << bits) - np.uint64(1)
    padded = np.append(label, np.uint64(0))
    for e in range(entries if len(has) else 0):
        odd = np.uint64(int.from_bytes(hashlib.blake2b(b"entry%d" % e, digest_size=8).digest(), "little") | 1)
        value = (label * odd) & ~low | place
        spots = np.full((len(has), taken), len(own), np.int64)  # beyond the end: no more k-mers
        for t in range(taken):
            least = np.minimum.reduceat(value, starts)
            some = least != top
            spots[some, t] = (least[some] & low).astype(np.int64)
            value[spots[some, t]] = top
        spots.sort(axis=1)
        key = np.full(len(has), e + 1, np.uint64)
        for t in range(taken):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + padded[spots[:, t]])
        keys[has, e] = key.view(np.int64)
    return keys, n_words


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _digests(texts: list[str]):
    """[n, 2] as int64: 128-bit digests."""
    import numpy as np

    return np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences, or ``most + 1`` where it is larger.

    Bit-parallel in the band of diagonals up to ``most`` (Hyyrö 2003): a window of ``2 * most + 1`` vertical
    differences moves down the matrix by one row a column.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    a, b = a[same:], b[same:]
    if not b:
        return len(a)
    limit, most = most, min(most, len(a))
    width = 2 * most + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    plus, minus, distance = (mask >> most) << most & mask, 0, most
    start = -most  # bit 0 of the window stands at this position of a
    level = top >> 1
    for j, y in enumerate(b):
        found = where.get(y, 0)
        match = (found >> start if start >= 0 else found << -start) & mask
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & mask
        up, down = (minus | ~(diagonal | plus)) & mask, diagonal & plus
        if j < len(a) - most:  # follow the band's lowest diagonal to the last row, then that row
            distance += not diagonal & top
        else:
            distance += bool(up & level) - bool(down & level)
            level >>= 1
        plus, minus = (down | ~((diagonal >> 1) | up)) & mask, (diagonal >> 1) & up
        start += 1
    return min(distance, limit + 1)


def edit_similarity(a: list, b: list, least: float) -> float:
    """1 - distance / longer length over words, or 0 where that is under ``least``."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    if most == 0:
        return float(a == b)
    distance = banded_distance(a, b, most)
    return 1 - distance / longer if distance <= most else 0.0


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("__text"))


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h1, h2, n_words, sketch): digest of the normalised text and its keys."""
    source, entries, taken = _source(docs, id_col, text_col), ENTRIES, TAKEN
    names = ["id", "h1", "h2", "n_words", "sketch"]

    def run(batches):
        import numpy as np

        for part in text_slices(batches, "__text"):
            texts = [normalised(t) for t in part.column(1).to_pylist()]
            digest = _digests(texts)
            keys, n_words = order_sketches(pa.array(texts, pa.large_string()), entries=entries, taken=taken)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()),
                                              pa.array(n_words.astype(np.int32)), sketch], names=names)

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, h1 long, h2 long, n_words int, sketch array<long>")


def _representative_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, __text, node, h1, h2): texts that may be those of ``wanted`` (id, node, h1, h2); their digests tell."""
    return _hash_filter(_source(docs, id_col, text_col), wanted, "id").join(wanted, "id").select("id", "__text", "node", "h1", "h2")


def _normalised_texts(part: pa.RecordBatch):
    """(nodes, normalised texts) of those rows of ``_representative_texts`` that have their node's digest."""
    import numpy as np

    texts = [normalised(t) for t in part.column(1).to_pylist()]
    same = np.flatnonzero((_digests(texts) == np.stack([part.column(3).to_numpy(), part.column(4).to_numpy()], 1)).all(1))
    return part.column(2).take(pa.array(same)), [texts[i] for i in same.tolist()]


def words_and_bags(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, words, bag) of the texts ``wanted`` (id, node, h1, h2): the hashes of their words in text order, and counted in ``BAG`` places."""
    names = ["node", "words", "bag"]

    def run(batches):
        import numpy as np

        for part in text_slices(batches, "__text"):
            nodes, texts = _normalised_texts(part)
            word, owner, n_words = word_hashes(pa.array(texts, pa.large_string()))
            ends = np.cumsum(n_words)
            words = [w.tobytes() for w in np.split(word, ends[:-1])] if texts else []
            yield pa.RecordBatch.from_arrays([nodes, pa.array(words, pa.binary()), pa.array([b.tobytes() for b in word_bags(word, owner, len(words))], pa.binary())], names=names)

    read = _representative_texts(docs, wanted, id_col, text_col).withColumn("__hash", F.xxhash64("__text")).dropDuplicates(["id", "node", "__hash"]).drop("__hash")
    return read.mapInArrow(run, "node long, words binary, bag binary")


def _hash_filter(docs: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """``docs`` whose hashed id is set in a bitmap of the hashed ids of ``wanted``: all of these, and few others."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    chunks = (wanted.select(place("id").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__chunk"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits")))  # FILTER_BITS / 32768 rows of 4 KB at most
    hit = docs.withColumn("__p", place(id_col)).join(F.broadcast(chunks), F.bitmap_bucket_number("__p") == F.col("__chunk"))
    byte = "cast(conv(hex(substring(__bits, cast(bitmap_bit_position(__p) div 8 as int) + 1, 1)), 16, 10) as int)"
    return hit.where(F.expr(f"shiftright({byte}, cast(bitmap_bit_position(__p) % 8 as int)) % 2 = 1")).select(*docs.columns)


def _named(nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, id, h1, h2) of ``nodes`` (node), written."""
    return written(nodes.distinct().join(reps.select("node", "id", "h1", "h2"), "node"), "candidate-ids")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """Links (src, dst, similarity) among candidate pairs (a, b) of nodes."""
    wanted = _named(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), reps)

    def read(batches):
        for part in text_slices(batches, "__text"):
            nodes, texts = _normalised_texts(part)
            yield pa.RecordBatch.from_arrays([nodes, pa.array(texts, pa.string())], names=["node", "text"])

    texts = written(_representative_texts(docs, wanted, id_col, text_col).mapInArrow(read, "node long, text string"), "candidate-texts")
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))
    names = ["src", "dst", "similarity"]

    def run(batches):
        for batch in batches:
            kept, values = [], []
            last, words_a = object(), []
            for i in range(batch.num_rows):
                ta = batch.column(2)[i].as_py()
                if ta != last:
                    last, words_a = ta, ta.split()
                value = edit_similarity(words_a, batch.column(3)[i].as_py().split(), similarity)
                if value >= similarity:
                    kept.append(i)
                    values.append(value)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(values, pa.float64())], names=names)

    return both.mapInArrow(run, "src long, dst long, similarity double")


def apart_buckets(members: DataFrame) -> DataFrame:
    """``members`` (key, node, n_words, component) of buckets of several components + (rare, blocks, rare_blocks): whether a row
    is outside its bucket's largest component, and in how many blocks the bucket's rows and such rows go."""
    size = (members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
            .groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("n_largest"), F.sum("words").alias("words"))
            .where("n > n_largest"))
    blocks = lambda n: F.ceil(F.greatest(n / BLOCK, F.col("words") * n / F.col("n") / BLOCK_WORDS)).cast("int")
    size = size.select("key", "largest", blocks(F.col("n")).alias("blocks"), blocks(F.col("n") - F.col("n_largest")).alias("rare_blocks"))
    return members.join(size, "key").withColumn("rare", F.col("component") != F.col("largest")).drop("largest")


def apart_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with (rare, blocks, rare_blocks) + (hash, low, high, seeks, met): blocks in which every row outside a bucket's largest
    component (rare) seeks all rows of other components that are met there.  A bucket of one block has each row once."""
    row = rows.withColumn("hash", F.xxhash64("node"))
    own, rare_own = F.pmod("hash", "blocks").cast("int"), F.pmod("hash", "rare_blocks").cast("int")
    place = lambda low, high, seeks, met: F.struct(low.alias("low"), high.alias("high"), seeks.alias("seeks"), met.alias("met"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    met = F.transform(F.sequence(zero, F.col("rare_blocks") - 1), lambda low: place(low, own, no, yes))
    seeking = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda high: place(rare_own, high, yes, no))
    many = F.when(F.col("rare"), F.concat(met, seeking)).otherwise(met)
    places = F.when(F.col("blocks") == 1, F.array(place(zero, zero, F.col("rare"), yes))).otherwise(many)
    return row.select(*row.columns, F.inline(places)).drop("blocks", "rare_blocks")


def _once_a_node(rows: DataFrame, *sides: DataFrame) -> DataFrame:
    """``rows`` joined with ``sides`` on node, each node's rows as one: the joins make a row a node, whatever the number of its buckets."""
    others = [c for c in rows.columns if c != "node"]
    full = rows.groupBy("node").agg(F.collect_list(F.struct(*others)).alias("rows"))
    for side in sides:
        full = full.join(side, "node")
    return full.select(*(c for c in full.columns if c != "rows"), F.inline("rows"))


class Block:
    """Rows of one block; ``partners`` are the rows that a seeker may link to."""

    def __init__(self, group: pa.Table, similarity: float) -> None:
        import numpy as np

        self.label = group["component"].to_numpy().copy()
        self.sketch = np.array(group["sketch"].to_pylist(), np.int64)
        self.bag = np.frombuffer(b"".join(group["bag"].to_pylist()), np.uint8).reshape(-1, BAG).astype(np.int16)
        self.n_words, self.hashed = group["n_words"].to_numpy().astype(np.int64), group["hash"].to_numpy()
        self.rare, seeks, met = (np.array(group[c].to_pylist(), bool) for c in ("rare", "seeks", "met"))
        self.key, self.similarity, self.others, self.seekers = group["key"][0].as_py(), similarity, np.flatnonzero(met), np.flatnonzero(seeks)

    def partners(self, i: int):
        """Those of most common keys first."""
        import numpy as np

        j = self.others[(self.label[self.others] != self.label[i]) & (~self.rare[self.others] | (self.hashed[self.others] >= self.hashed[i]))]
        band = ((1 - self.similarity) * np.maximum(self.n_words[j], self.n_words[i]) + 1e-9).astype(np.int64)
        fits = np.abs(self.n_words[j] - self.n_words[i]) <= band
        j, band = j[fits], band[fits]
        entry = int((self.sketch[i] == self.key).argmax())  # a pair is settled in the bucket of its first common key
        first = ~(self.sketch[j, :entry] == self.sketch[i, :entry]).any(1)
        j, band = j[first], band[first]
        gap = self.bag[j] - self.bag[i]
        more = np.maximum(gap, 0).sum(1, dtype=np.int64)  # words that only j has; those that only i has follow from the sums
        j = j[np.maximum(more, more - gap.sum(1, dtype=np.int64)) <= band]
        agree = (self.sketch[j] == self.sketch[i]).sum(1)
        return j[np.argsort(-agree, kind="stable")]


def settled(members: DataFrame, sketches: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Links (src, dst, similarity) that join components of ``members`` (key, node, n_words, component) within a key."""
    rows = apart_blocks(_once_a_node(apart_buckets(members), words.select("node", "bag"), sketches))
    at = ["key", "low", "high"]
    columns = [("key", "long"), ("low", "int"), ("high", "int"), ("node", "long"), ("component", "long"), ("n_words", "int"), ("hash", "long"),
               ("rare", "boolean"), ("seeks", "boolean"), ("met", "boolean")]

    def open_rows(group: pa.Table) -> pa.Table:
        import numpy as np

        if not group.num_rows:
            return group.select([c for c, _ in columns])
        block, found = Block(group, similarity), np.zeros(group.num_rows, bool)
        for i in block.seekers:
            j = block.partners(int(i))
            found[j] = True
            found[i] |= len(j) > 0
        return group.filter(pa.array(found)).select([c for c, _ in columns])

    def links(group: pa.Table) -> pa.Table:
        import numpy as np

        block, out = Block(group, similarity), []
        nodes = group["node"]
        text = [np.frombuffer(w, np.uint64).tolist() for w in group["words"].to_pylist()]
        for i in block.seekers:
            for j in block.partners(i).tolist():
                if block.label[j] != block.label[i]:
                    value = edit_similarity(text[i], text[j], similarity)
                    if value >= similarity:
                        out.append((i, j, value))
                        block.label[block.label == block.label[j]] = block.label[i]
        i, j, value = (list(x) for x in zip(*out)) if out else ([], [], [])
        return pa.Table.from_arrays([nodes.take(pa.array(i, pa.int64())), nodes.take(pa.array(j, pa.int64())), pa.array(value, pa.float64())], names=["src", "dst", "similarity"])

    ddl = ", ".join(f"{c} {t}" for c, t in columns)
    left = written(rows.groupBy(*at).applyInArrow(open_rows, ddl), "open-rows")
    return _once_a_node(left, words, sketches).groupBy(*at).applyInArrow(links, "src long, dst long, similarity double")


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) when ``links`` are added to ``parts``."""
    named = parts.select(F.col("node").alias("id"), "component")
    ends = links.join(named.withColumnsRenamed({"id": "src", "component": "c1"}), "src", "left")
    ends = ends.join(named.withColumnsRenamed({"id": "dst", "component": "c2"}), "dst", "left")
    joined = connected_components(ends.select(F.coalesce("c1", "src").alias("src"), F.coalesce("c2", "dst").alias("dst")))
    joined = written(joined.withColumnsRenamed({"node": "old", "component": "new"}), "joined-components")
    moved = parts.join(joined, parts["component"] == joined["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    alone = joined.join(parts, joined["old"] == parts["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return moved.unionByName(alone)


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(id, copy_of, class_id) of every row of ``docs``."""
    sketches = written(sketch_documents(docs, id_col, text_col), "sketches")
    copies = sketches.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch"))
    reps = written(copies.where("id is not null").withColumn("node", F.monotonically_increasing_id()), "representatives")  # numbers hold, as they are written

    def bucket_rows() -> DataFrame:
        buckets = reps.where("n_words > 0").select("node", "n_words", F.explode("sketch").alias("key"))
        size = written(buckets.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub"), "keys")
        return buckets.join(size, "key")

    shared = step(bucket_rows, "buckets")

    def star_links() -> DataFrame:
        met = shared.where("node <> hub").groupBy("node", "hub").agg(F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("times"))
        met = met.join(reps.select(F.col("node").alias("hub"), F.col("n_words").alias("hub_words")), "hub")
        met = met.where(F.least("n_words", "hub_words") >= similarity * F.greatest("n_words", "hub_words"))
        best = met.groupBy("node").agg(F.max(F.struct("times", "hub")).alias("best"))
        stars = written(best.select(F.col("best.hub").alias("a"), F.col("node").alias("b")), "star-pairs")
        return _verified(stars, reps, docs, id_col, text_col, similarity)

    def parts_of_stars() -> DataFrame:
        again = reps.groupBy("id").agg(F.min("node").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1")
        one_id = reps.select("id", F.col("node").alias("src")).join(again, "id").select("src", "dst")  # several texts
        return connected_components(step(star_links, "links").select("src", "dst").unionByName(one_id))

    parts = step(parts_of_stars, "components")

    def apart_rows() -> DataFrame:  # buckets with several components
        inside = shared.join(parts, "node", "left").select("key", "node", "n_words", F.coalesce("component", "node").alias("component"))
        several = inside.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("key")
        return inside.join(several, "key", "left_semi")

    left_apart = step(apart_rows, "apart")

    def joining_links() -> DataFrame:
        wanted = _named(left_apart.select("node"), reps)
        words = written(words_and_bags(docs, wanted, id_col, text_col), "candidate-words")
        return settled(left_apart, reps.select("node", "sketch"), words, similarity)

    if not left_apart.isEmpty():
        links, old = step(joining_links, "links"), parts
        parts = step(lambda: _joined(old, links), "components")
    least = reps.select("node", "id").join(parts, "node").groupBy("component").agg(F.min("id").alias("class_id"))
    named = reps.select("h1", "h2", "id", "node").join(parts.join(least, "component").select("node", "class_id"), "node", "left")
    rep = named.select("h1", "h2", F.col("id").alias("rep"), F.coalesce("class_id", "id").alias("class_id"))
    member = sketches.select("id", "h1", "h2").join(rep, ["h1", "h2"], "left")
    return member.select("id", F.col("rep").alias("copy_of"), "class_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: (id_col, copy_of, class_id): its representative among equal texts, and its class's least id."""
    ship(docs.sparkSession)
    return step(lambda: _classes(docs, id_col, text_col, similarity), "classes").toDF(id_col, "copy_of", "class_id")


@query("op5_order_minhash")
def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
