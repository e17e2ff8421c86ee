"""Operator 11: grouping of spelling variants with k-d trees over letter counts.

Words are maximal runs of letters (``[A-Za-z]`` and U+00C0 to U+00FF), A-Z in
lower case; one in ``TYPO_EVERY`` (text, run) pairs, by CRC-32, loses a letter.
Words of at least ``LETTERS`` letters and ``OFTEN`` occurrences are grouped: two
are near if one inserted, deleted or replaced letter turns one into the other, a
word's form is its most frequent near word if that is ``RATIO`` times as
frequent, and its root is where the forms lead.

A word is a point with its number of each letter as coordinates.  One edit moves
it by an L1 distance of 2 (replaced; equal lengths) or 1 (lengths differ by
one), so near words are found by range searches, for each pair of lengths
(l, l) and (l, l + 1):

* The words of a length fall into the leaves (cells) of a k-d tree whose upper
  part is fitted on ``SAMPLE`` words by hash, split at medians until a cell has
  about ``CELL`` words of all.  Every word is in exactly one cell; a word goes as a
  query to the cells that its letters can reach: one letter more and, for equal
  lengths, one letter less.  The sample only shapes the cells.
* In a task a cell's words stand in a k-d tree with bounding boxes; queries go down
  in batches, and a box is left out if its L1 distance is too large.
* What the letter counts allow is verified on the letters' order.

Each near pair is found once and leaves the task as counters of its two words
(near words, the best one), never as a pair.  A cell larger than ``CELL`` (many
words of equal letters, a poor sample) is cut into blocks by hash, and so are
its queries, so a task's memory is bounded whatever the words are.  Forms grow
by ``RATIO`` at each step, so chains are short: roots follow by pointer doubling.

Defined cases: null and empty texts have no words; a null id is an empty text
in the CRC's input; rows with equal ids count each; an empty table gives no rows;
extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.llm.common import query, ship, table, text_slices, written

TYPO_EVERY, LETTERS, OFTEN, RATIO = 199, 6, 5, 5
SAMPLE, CELL, QUERIES_A_CELL, LEAF = 1 << 16, 4096, 16, 32
MAX_COUNTED = 1 << 19  # different words a task counts before it hands them on
FIRST_LETTERS = bytes(range(97, 123)) + bytes(range(0xC0, 0x100))
CLEAN = bytes((c + 32 if 65 <= c <= 90 else c) if (65 <= c <= 90 or c in FIRST_LETTERS) else 32 for c in range(256))
AXES = len(FIRST_LETTERS)


# ---------------------------------------------------------------- words
def words_of(text: str | None) -> list[bytes]:
    """The runs of letters, one byte (its code point) a letter; other code points part them."""
    return (text or "").encode("latin-1", "replace").translate(CLEAN).split()


def with_typo(prefix: int, word: bytes) -> bytes:
    """The word as it counts: without a letter where the CRC-32 of ``<id>:<word>`` says so (``prefix``: that of ``<id>:``)."""
    import zlib

    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
    if h % TYPO_EVERY:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import zlib

        found: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for part in text_slices(batches, "text"):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                prefix = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(words_of(text)).items():
                    if len(word) >= LETTERS:
                        word = with_typo(prefix, word)
                        if len(word) >= LETTERS:
                            found[word] += n
                if len(found) > MAX_COUNTED:
                    yield rows()
                    found.clear()
        yield rows()

    counted = source.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def letter_counts(words: list[bytes]):
    """[words, AXES] as int8: how often each letter stands in each word (up to 127, which only shortens distances)."""
    import numpy as np

    axis = np.full(256, -1, np.int64)
    axis[np.frombuffer(FIRST_LETTERS, np.uint8)] = np.arange(AXES)
    flat = np.frombuffer(b"".join(words), np.uint8)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(owner * AXES + axis[flat], minlength=len(words) * AXES)
    return np.minimum(counts, 127).astype(np.int8).reshape(len(words), AXES)


# ---------------------------------------------------------------- cells
def split_tree(points, leaves: int) -> list[tuple]:
    """A k-d tree on sample points with about ``leaves`` leaves: nodes (axis, most, left, right), or (-1, cell, 0, 0).

    Widest axis first, at its median; a leaf whose points are all equal stays whole.
    """
    import numpy as np

    nodes: list[tuple] = []
    cells = 0

    def grow(rows, share: float) -> int:
        nonlocal cells
        at = len(nodes)
        nodes.append(())
        if share >= 1.5 and len(rows) >= 2:
            part = points[rows].astype(np.int64)
            axis = int(part.var(0).argmax())
            most = int(np.sort(part[:, axis])[(len(rows) - 1) // 2])
            if most == part[:, axis].max():
                most -= 1
            left = part[:, axis] <= most
            if left.any() and not left.all():
                part_left = left.mean()
                a = grow(rows[left], share * part_left)
                b = grow(rows[~left], share * (1 - part_left))
                nodes[at] = (axis, most, a, b)
                return at
        nodes[at] = (-1, cells, 0, 0)
        cells += 1
        return at

    grow(np.arange(len(points)), float(leaves))
    return nodes


def reached(nodes: list[tuple], points, more: int, less: int) -> list[tuple]:
    """(cell, rows) pairs: the cells that ``points`` reach if up to ``more`` letters are added and ``less`` taken away.

    Only splits that a path crosses count; a letter that crosses two splits of one axis is counted twice at
    most where the counts differ by as much, so no cell within reach is left out.
    """
    import numpy as np

    found = []
    n = len(points)
    stack = [(0, np.arange(n), np.zeros(n, np.int8), np.zeros(n, np.int8), {})]
    while stack:
        at, rows, up, down, crossed = stack.pop()
        axis, most, left, right = nodes[at]
        if axis < 0:
            if len(rows):
                found.append((most, rows))
            continue
        value = points[rows, axis].astype(np.int64)
        had = crossed.get(axis)
        had_up, had_down = had if had else (np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64))
        # to the left: the count may be at most `most`; to the right: at least `most + 1`
        for child, need_up, need_down in ((left, had_up, np.maximum(had_down, value - most)), (right, np.maximum(had_up, most + 1 - value), had_down)):
            new_up, new_down = up + (need_up - had_up), down + (need_down - had_down)
            ok = (new_up <= more) & (new_down <= less)
            if ok.any():
                kept = {a: (u[ok], d[ok]) for a, (u, d) in crossed.items()}
                kept[axis] = (need_up[ok], need_down[ok])
                stack.append((child, rows[ok], new_up[ok], new_down[ok], kept))
    return found


def cell_trees(words: DataFrame) -> dict[int, list[tuple]]:
    """Upper trees of the lengths that have more than ``CELL`` words, fitted on ``SAMPLE`` words by hash.

    The driver gets a row per such length, and the letters of the sample.
    """
    import numpy as np

    sizes = {r["length"]: r["n"] for r in words.groupBy("length").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).collect()}
    if not sizes:
        return {}
    sorted_letters = F.array_join(F.array_sort(F.split("word", "")), "")
    sample = words.where(F.col("length").isin(list(sizes))).orderBy(F.xxhash64("word")).limit(SAMPLE).select("length", sorted_letters.alias("letters")).collect()
    by_length: dict[int, list[bytes]] = {}
    for r in sample:
        by_length.setdefault(r["length"], []).append(r["letters"].encode("latin-1"))
    return {length: split_tree(letter_counts(by_length.get(length, [])), -(-n // CELL)) for length, n in sizes.items()}


ONE_CELL = [(-1, 0, 0, 0)]


def placed(words: DataFrame, trees: dict[int, list[tuple]]) -> DataFrame:
    """(length, cell, asks, word, n): each word in its cell, and as a query (asks) in those that it reaches."""
    shared = words.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        import numpy as np

        for whole in batches:
            for first in range(0, whole.num_rows, 8192):
                batch = whole.slice(first, 8192)
                words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
                lengths = np.array([len(w) for w in words])
                for length in np.unique(lengths).tolist():
                    rows = np.flatnonzero(lengths == length)
                    points = letter_counts([words[i] for i in rows])
                    own, longer = (shared.value.get(x, ONE_CELL) for x in (length, length + 1))
                    for target, asks, nodes, more, less in ((length, False, own, 0, 0), (length, True, own, 1, 1), (length + 1, True, longer, 1, 0)):
                        for cell, which in reached(nodes, points, more, less):
                            m, at = len(which), pa.array(rows[which])
                            yield pa.RecordBatch.from_arrays([pa.array([target] * m, pa.int32()), pa.array([cell] * m, pa.int32()), pa.array([asks] * m, pa.bool_()),
                                                              batch.column(0).take(at), batch.column(1).take(at)], names=["length", "cell", "asks", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "length int, cell int, asks boolean, word string, n long")


def blocked(rows: DataFrame) -> DataFrame:
    """``rows`` + (own, other): blocks of a cell's words and of its queries; each of one meets each of the other."""
    per_cell = F.greatest(F.lit(1), F.least(F.lit(CELL), F.floor(F.lit(1 << 22) / F.col("length"))))  # very long words: fewer
    size = rows.groupBy("length", "cell").agg(F.count_if(~F.col("asks")).alias("n_own"), F.count_if("asks").alias("n_asks")).where("n_own > 0").select(
        "length", "cell", F.ceil(F.col("n_own") / per_cell).cast("int").alias("owns"), F.greatest(F.lit(1), F.ceil(F.col("n_asks") / (per_cell * QUERIES_A_CELL))).cast("int").alias("others"))
    block, joined = F.xxhash64("word"), rows.join(size, ["length", "cell"])
    columns = ["length", "cell", "own", "other", "asks", "word", "n"]
    own = joined.where("not asks").withColumns({"own": F.pmod(block, "owns").cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("others") - 1))})
    asks = joined.where("asks").withColumns({"other": F.pmod(block, "others").cast("int"), "own": F.explode(F.sequence(F.lit(0), F.col("owns") - 1))})
    return own.select(*columns).unionByName(asks.select(*columns))


# ---------------------------------------------------------------- search in a cell
def range_search(points, asks, most: int):
    """(point, ask) index pairs whose L1 distance is at most ``most``, by a k-d tree with bounding boxes, asks in batches."""
    import numpy as np

    used = np.flatnonzero((points != 0).any(0) | (asks != 0).any(0))
    points, asks = points[:, used], asks[:, used]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    stack = [(np.arange(len(points)), np.arange(len(asks)))]
    while stack:
        rows, alive = stack.pop()
        if not len(rows) or not len(alive):
            continue
        box, at = points[rows], asks[alive]
        low, high = box.min(0), box.max(0)
        away = (np.maximum(low - at, 0) + np.maximum(at - high, 0)).sum(1, dtype=np.int64)
        alive, at = alive[away <= most], at[away <= most]
        if len(rows) <= LEAF or (low == high).all():
            step = max(1, (1 << 21) // max(len(used), 1) // len(rows))
            for first in range(0, len(alive), step):
                gap = np.abs(at[first:first + step, None, :] - box[None, :, :]).sum(2, dtype=np.int64)
                a, p = np.nonzero(gap <= most)
                found.append((rows[p], alive[first + a]))
            continue
        axis = int((high.astype(np.int64) - low).argmax()) if len(rows) < 64 else int(box.var(0).argmax())
        middle = int(np.sort(box[:, axis])[(len(rows) - 1) // 2])
        if middle == high[axis]:
            middle -= 1
        left = box[:, axis] <= middle
        stack += [(rows[left], alive), (rows[~left], alive)]
    return tuple(np.concatenate(x) for x in zip(*found))


def one_edit(a, b):
    """Which rows of code arrays a [m, l] and b [m, l or l + 1] differ by exactly one replaced or inserted letter."""
    import numpy as np

    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    same = a == b[:, :-1]
    first = np.where(same.all(1), a.shape[1], same.argmin(1))  # where the letter is inserted
    rest = a == b[:, 1:]
    return (rest | (np.arange(a.shape[1])[None, :] < first[:, None])).all(1)


def codes(words: list[bytes]):
    import numpy as np

    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), len(words[0]) if words else 0)


def near_counters(group: pa.Table) -> pa.Table:
    """(word, n_near, best): for the words of one block and the queries that reach it."""
    import numpy as np

    asks = np.array(group["asks"].to_pylist(), bool)
    text = group["word"].to_pylist()
    words = [w.encode("latin-1") for w in text]
    n = group["n"].to_numpy()
    length = group["length"][0].as_py()
    own = np.flatnonzero(~asks)
    near = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    sizes = np.array([len(w) for w in words])
    own_points, own_codes = letter_counts([words[i] for i in own]), codes([words[i] for i in own])
    for ask_length, most in ((length, 2), (length - 1, 1)):
        rows = np.flatnonzero(asks & (sizes == ask_length))
        if not len(rows) or not len(own):
            continue
        p, a = range_search(own_points, letter_counts([words[i] for i in rows]), most)
        ask_codes = codes([words[i] for i in rows])
        for first in range(0, len(p), 1 << 16):
            x, y = p[first:first + (1 << 16)], a[first:first + (1 << 16)]
            keep = one_edit(ask_codes[y], own_codes[x])
            x, y = own[x[keep]], rows[y[keep]]
            if ask_length == length:  # both words ask for each other: the smaller one counts
                smaller = np.array([text[j] < text[i] for i, j in zip(x.tolist(), y.tolist())], bool)
                x, y = x[smaller], y[smaller]
            near.append((x, y))
    x, y = (np.concatenate(v) for v in zip(*near))
    found: dict[str, list] = {}
    for i, j in zip(np.concatenate([x, y]).tolist(), np.concatenate([y, x]).tolist()):
        entry, best = found.setdefault(text[i], [0, None]), (-int(n[j]), text[j])
        entry[0] += 1
        entry[1] = best if entry[1] is None or best < entry[1] else entry[1]
    return pa.table({"word": pa.array(found, pa.string()), "n_near": pa.array([e[0] for e in found.values()], pa.int64()),
                     "best_n": pa.array([-e[1][0] for e in found.values()], pa.int64()), "best": pa.array([e[1][1] for e in found.values()], pa.string())})


# ---------------------------------------------------------------- forms and roots
def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the forms lead, by pointer doubling."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("via"), F.col("root").alias("far"))
        joined = at.join(further, F.col("root") == F.col("via"), "left")
        new = written(joined.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: (word, form, root, n, n_near, form_n)."""
    ship(docs.sparkSession)
    words = written(word_counts(docs, id_col, text_col).withColumn("length", F.length("word")), "spelling-words")
    rows = written(placed(words, cell_trees(words)), "spelling-cells")
    found = blocked(rows).groupBy("length", "cell", "own", "other").applyInArrow(near_counters, "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("key"), F.col("best").alias("best"))).alias("top"))
    joined = words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("top.best").alias("best"), (-F.col("top.key")).alias("best_n"))
    good = F.col("best_n") >= RATIO * F.col("n")
    formed = written(joined.select("word", "n", "n_near", F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = with_roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _sql() -> str:
    return r"""with recursive table_of as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when (c & 1) = 1 then xor(3988292384, c >> 1) else c >> 1 end, i)) as t),
      runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) as run from documents),
      counted as (select doc_id, run, count(*) as n from runs group by 1, 2),
      bytes as (select *, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda b: cast('0x' || b as bigint)) as b from counted where len(run) >= 6),
      hashed as (select run, n, xor(4294967295, list_reduce(b, lambda c, x: xor(t[cast((xor(c, x) & 255) as int) + 1], c >> 8), cast(4294967295 as bigint))) as h from bytes, table_of),
      spelled as (select case when h % 199 = 0 then substr(run, 1, cast(h % len(run) as int)) || substr(run, cast(h % len(run) as int) + 2) else run end as word, n from hashed),
      words as materialized (select word, cast(sum(n) as bigint) as n from spelled where len(word) >= 6 group by 1 having sum(n) >= 5),
      cut as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select *, unnest(range(1, len(word) + 1)) as i from words)),
      near as materialized (select distinct a.word, b.word as other, b.n as m from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
        union select c.word, w.word, w.n from cut c join words w on c.rest = w.word union select w.word, c.word, c.n from cut c join words w on c.rest = w.word),
      best as (select word, count(*) as n_near, min(struct_pack(k := -m, w := other)) as top from near group by 1),
      formed as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -top.k >= 5 * w.n then top.w end as form, case when -top.k >= 5 * w.n then -top.k end as form_n
        from words w left join best b on w.word = b.word),
      follow(word, last, step) as (select word, word, 0 from formed union all select f.word, g.form, f.step + 1 from follow f join formed g on f.last = g.word where g.form is not null)
      select f.word, f.form, r.root, f.n, f.n_near, f.form_n from formed f join (select word, max_by(last, step) as root from follow group by 1) r on f.word = r.word"""


@query("op11_spelling_groups", _sql())
def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))
