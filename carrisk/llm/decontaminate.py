"""Operator 2: benchmark decontamination by latent semantic retrieval.

Items of the benchmark are the stated query set; every passage of every
document (``WINDOW`` words, one each ``STRIDE`` words) is searched for them.

1. Documents are read once and reduced to the benchmark's words: their numbers
   and the count of other words before each, written to the shared folder.
2. Document frequencies of these words over all passages give TF-IDF weights
   (``log(1 + N / df)`` of N passages, which falls smoothly: no word is cut, at
   any size) and unit rows A.
3. Randomised SVD over all passages and the items themselves (rows that weigh
   as much as all passages, so every item has a direction): tasks add up ``A^T (A X)`` for a random X,
   and ``POWER_STEPS`` times for its orthonormal basis Q; the eigenvectors of ``Q^T A^T A Q``
   turn Q into the ``RANK`` latent directions.  Partial sums are streamed
   together by blocks of words; only words x RANK numbers, bounded by the
   benchmark's block, reach the driver.
4. Candidates: a passage and an item of latent cosine ``COSINE`` or more,
   as one matrix product for a block of passages against all items; and, as
   the cosine proves nothing, each place that holds as much IDF of an item's
   rarest words as no match can do without (``Items.index``).  The second
   route misses no match of step 5, whatever the latent space holds.
5. Checks, in the same task: the longest common subsequence of item and text
   around the passage.  ``COPY`` of the item's words make a copy; from
   ``PARAPHRASE`` of them on it is a paraphrase, if the matched words also
   hold ``RARE`` of the item's IDF and its answer (its last ``ANSWER`` words)
   is there by ``PARAPHRASE``.

A benchmark of more than ``BLOCK_CHARS`` characters is taken in blocks of
items, each searched against all documents, so what the driver and a broadcast
hold is bounded at every size.  A document meets all items in one task.

Defined cases: null and empty texts hold nothing; items that are null, have
no words or a null id match nothing; equal items and rows each give their
rows; an empty table gives none; extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.llm.common import query, table, text_slices, written

WINDOW, STRIDE, RANK, OVERSAMPLE = 40, 20, 160, 16
COSINE, COPY, PARAPHRASE, RARE, ANSWER = 0.45, 0.8, 0.5, 0.5, 5
MARGIN, EVENTS = 0.2, 1_000_000
BLOCK_CHARS, SUM_WORDS, POWER_STEPS, SEED = 2_000_000, 256, 2, 7
MARKS = ".,;:!?\"'()[]{}<>|*#_-–—…“”„«»¿¡"


def word_lists(texts: pa.Array):
    """(flat words, owner of each): lower case, without marks at their ends."""
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))
    words = pc.utf8_trim(lists.flatten(), characters=MARKS)
    real = pc.greater(pc.binary_length(words), 0)
    return words.filter(real), pc.list_parent_indices(lists).filter(real).to_numpy().astype(np.int64)


class Items:
    """A block of benchmark items: vocabulary, word numbers of each item, and (once fitted) the latent space."""

    def __init__(self, rows: list[tuple]):
        import numpy as np

        flat, owner = word_lists(pa.array([t or "" for _, t in rows], pa.large_string()))
        coded = flat.dictionary_encode()
        self.vocab = coded.dictionary
        codes = coded.indices.to_numpy().astype(np.int64)
        words = [codes[owner == i] for i in range(len(rows))]
        self.ids = [i for (i, _), w in zip(rows, words) if len(w) and i is not None]
        self.words = [w for (i, _), w in zip(rows, words) if len(w) and i is not None]
        self.where = []  # bit masks of each word's places, for the bit-parallel LCS
        for w in self.words:
            masks: dict[int, int] = {}
            for k, x in enumerate(w.tolist()):
                masks[x] = masks.get(x, 0) | 1 << k
            self.where.append(masks)
        self.idf = None

    def fit(self, df, passages: int) -> None:
        import numpy as np

        self.idf = np.log1p(passages / np.maximum(df, 1))
        self.passages = passages
        self.index()

    def index(self) -> None:
        """Postings of each item's rarest words, and the least IDF of them that any match of the item holds.

        A copy leaves out at most ``1 - COPY`` of the words, a paraphrase at most ``1 - RARE`` of the IDF.  So of any
        words with more IDF than that, a match holds the rest; ``MARGIN`` of the item's IDF beyond it is indexed, which
        only decides how many places are looked at.
        """
        import numpy as np

        words, owner, self.least = [], [], np.zeros(len(self.words))
        for k, w in enumerate(self.words):
            rarest = w[np.argsort(-self.idf[w], kind="stable")]
            weight = self.idf[rarest]
            total = weight.sum()
            spare = max((1 - RARE) * total, weight[:int((1 - COPY) * len(w) + 1e-9)].sum())
            taken = min(int(np.searchsorted(np.cumsum(weight), min(spare + MARGIN * total, total))) + 1, len(w))
            taken = int(np.flatnonzero(np.isin(rarest, rarest[:taken]))[-1]) + 1  # a word with all its places
            self.least[k] = (weight[:taken].sum() - spare) * (1 - 1e-6)
            found = np.unique(rarest[:taken])
            words.append(found)
            owner.append(np.full(len(found), k))
        words, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, owner))
        order = np.argsort(words, kind="stable")
        self.holders, self.ends = owner[order], np.searchsorted(words[order], np.arange(len(self.idf) + 1))

    def gram_times(self, x):
        """``B^T B x`` of the items' unit rows B, which together weigh as much as all passages."""
        import numpy as np

        word, start, weight = [], [], []
        for w in self.words:
            found, count = np.unique(w, return_counts=True)
            row = count * self.idf[found]
            norm = np.linalg.norm(row)
            start.append(start[-1] + len(word[-1]) if start else 0)
            word.append(found)
            weight.append(row / norm if norm else row)
        word, start, weight = np.concatenate(word), np.array(start), np.concatenate(weight)
        y = _times(start, word, weight.astype(np.float32), x.astype(np.float32)).astype(np.float64)
        out = np.zeros(x.shape)
        np.add.at(out, word, np.repeat(y, np.diff(np.append(start, len(word))), axis=0) * weight[:, None])
        return out * (self.passages / len(self.words))

    def project(self, basis) -> None:
        import numpy as np

        self.basis = basis.astype(np.float32)
        rows = np.stack([(np.bincount(w, minlength=len(self.idf)) * self.idf) @ basis for w in self.words])
        self.latent = (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def encode_documents(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """(id, words, skips): the benchmark words of each text in order, and how many other words stand before each."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("__text"))
    vocab = source.sparkSession.sparkContext.broadcast(items.vocab)

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        for part in text_slices(batches, "__text"):
            flat, owner = word_lists(pc.fill_null(part.column(1), ""))
            code = pc.fill_null(pc.index_in(flat, value_set=vocab.value), -1).to_numpy().astype(np.int32)
            first = np.append(0, np.cumsum(np.bincount(owner, minlength=part.num_rows)))
            at = np.flatnonzero(code >= 0)
            own = owner[at]
            place = at - first[own]
            skips = np.diff(place, prepend=-1) - 1
            new = np.flatnonzero(np.diff(own, prepend=-1))
            skips[new] = place[new]
            ends = pa.array(np.searchsorted(own, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (code[at], skips.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["id", "words", "skips"])

    kind = source.schema["id"].dataType.simpleString()
    return written(source.mapInArrow(run, f"id {kind}, words array<int>, skips array<int>").where("size(words) > 0"), "benchmark-words")


class Passages:
    """Passages of a slice of encoded documents."""

    def __init__(self, part: pa.RecordBatch):
        import numpy as np

        lists = part.column(1)
        self.ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy().astype(np.int64)))
        self.words = lists.flatten().to_numpy().astype(np.int64)
        skips = part.column(2).flatten().to_numpy().astype(np.int64)
        self.owner = np.repeat(np.arange(part.num_rows), np.diff(self.ends))
        far = np.cumsum(skips + 1) - 1
        base = np.append(0, far + 1)[self.ends[:-1]]
        self.place = far - base[self.owner]  # word position in the document
        last = np.maximum.reduceat(self.place, self.ends[:-1]) if len(self.words) else np.zeros(0, np.int64)
        per_doc = last // STRIDE + 1  # passage w starts at word (w - 1) * STRIDE; passage 0 is the part before the first full one
        self.first = np.append(0, np.cumsum(per_doc + 1))
        self.n = int(self.first[-1])

    def entries(self, keep):
        """(passage, word, count), by passage: every kept word lies in two passages."""
        import numpy as np

        use = np.flatnonzero(keep[self.words]) if len(self.words) else np.zeros(0, np.int64)
        here = self.first[self.owner[use]] + self.place[use] // STRIDE
        key = np.concatenate([here, here + 1]) * len(keep) + np.tile(self.words[use], 2)
        key, count = np.unique(key, return_counts=True)
        return key // len(keep), key % len(keep), count


def _slices(batches):
    for batch in batches:
        for r in range(0, batch.num_rows, 300):
            yield batch.slice(r, 300)


def document_frequencies(encoded: DataFrame, n_words: int):
    """(df of each word over all passages, number of passages)."""
    import numpy as np

    def run(batches):
        df, passages = np.zeros(n_words, np.int64), 0
        for part in _slices(batches):
            p = Passages(part)
            df += np.bincount(p.entries(np.ones(n_words, bool))[1], minlength=n_words)
            passages += p.n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], passages))], names=["word", "n"])

    rows = encoded.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(n_words, np.int64)
    for r in rows:
        if r.word >= 0:
            df[r.word] = r.n
    return df, next((r.n for r in rows if r.word < 0), 0)


def _rows_of(p: Passages, idf, keep):
    """Unit TF-IDF rows of the passages that have any: (passage numbers, their first entries, word, weight)."""
    import numpy as np

    passage, word, count = p.entries(keep)
    weight = count * idf[word]
    has, start = np.unique(passage, return_index=True)
    if len(has):
        norm = np.sqrt(np.add.reduceat(weight ** 2, start))
        weight = weight / np.repeat(norm, np.diff(np.append(start, len(weight))))
    return has, start, word, weight.astype(np.float32)


def _times(start, word, weight, matrix, step: int = 1000):
    """A @ matrix, in steps of about ``step`` entries, which stay in a core's cache."""
    import numpy as np

    out = np.zeros((len(start), matrix.shape[1]), np.float32)
    ends = np.append(start, len(word))
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + step, side="right")) - 1)
        a, b = ends[first], ends[last]
        out[first:last] = np.add.reduceat(matrix[word[a:b]] * weight[a:b, None], start[first:last] - a, axis=0)
        first = last
    return out


def gram_times(encoded: DataFrame, idf, x):
    """``A^T A x`` over all passages, summed by blocks of ``SUM_WORDS`` words."""
    import numpy as np

    shared = encoded.sparkSession.sparkContext.broadcast((idf, x.astype(np.float32)))
    n_words, width = x.shape
    blocks = -(-n_words // SUM_WORDS)

    def part_sums(batches):
        idf_, x_ = shared.value
        keep = idf_ > 0
        total = np.zeros((blocks * SUM_WORDS, width), np.float32)
        for part in _slices(batches):
            _, start, word, weight = _rows_of(Passages(part), idf_, keep)
            if not len(start):
                continue
            y = _times(start, word, weight, x_)
            row = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(word))))
            order = np.argsort(word, kind="stable")
            found, first = np.unique(word[order], return_index=True)
            total[found] += _times(first, row[order], weight[order], y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks)), pa.array([b.tobytes() for b in np.split(total, blocks)], pa.binary())], names=["block", "sums"])

    def add(batches):
        total: dict[int, object] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = np.frombuffer(sums.as_buffer(), np.float32).astype(np.float64)
                total[block] = total[block] + value if block in total else value
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "sums"])

    schema = "block long, sums binary"
    out = np.zeros((blocks * SUM_WORDS, width))
    for r in encoded.mapInArrow(part_sums, schema).repartition(blocks, "block").mapInArrow(add, schema).collect():
        out[r.block * SUM_WORDS:(r.block + 1) * SUM_WORDS] = np.frombuffer(r.sums).reshape(SUM_WORDS, width)
    return out[:n_words]


def latent_basis(encoded: DataFrame, idf, rank: int = RANK, seed: int = SEED, items: Items | None = None):
    """words x rank: the leading right singular vectors of A (and the rows of ``items``), by a randomised range finder with ``POWER_STEPS`` power steps."""
    import numpy as np

    def times(x):
        return gram_times(encoded, idf, x) + (items.gram_times(x) if items else 0)

    width = min(rank + OVERSAMPLE, len(idf))
    z = times(np.random.default_rng(seed).standard_normal((len(idf), width)))
    for _ in range(POWER_STEPS):
        q, _ = np.linalg.qr(z)
        z = times(q)
    small = q.T @ z
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(values)[::-1][:rank]
    return q @ vectors[:, best]


def common_length(where: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over an item's ``n`` words."""
    full = (1 << n) - 1
    row = full
    for w in words:
        found = where.get(w)
        if found:
            u = row & found
            row = (row + u | row - u) & full
    return n - row.bit_count()


def common_places(item: list[int], words: list[int]) -> list[int]:
    """Places in ``item`` of one longest common subsequence."""
    rows = [[0] * (len(words) + 1)]
    for x in item:
        above, row = rows[-1], [0]
        for j, y in enumerate(words):
            row.append(above[j] + 1 if x == y else max(row[j], above[j + 1]))
        rows.append(row)
    out, i, j = [], len(item), len(words)
    while i and j:
        if item[i - 1] == words[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def judge_match(items: Items, k: int, words: list[int]) -> tuple[str, float] | None:
    """("copy" or "paraphrase", share of the item found) of item ``k`` in ``words``, or None."""
    item = items.words[k].tolist()
    share = common_length(items.where[k], len(item), words) / len(item)
    if share >= COPY:
        return "copy", share
    if share < PARAPHRASE:
        return None
    places = common_places(item, words)
    weight = items.idf[items.words[k]]
    if weight[places].sum() < RARE * weight.sum():
        return None
    answer = Counter(item[-ANSWER:])
    found = sum((answer & Counter(words)).values())
    return ("paraphrase", share) if found >= PARAPHRASE * sum(answer.values()) else None


def places_by_words(p: Passages, items: Items):
    """(passage, item), in order: every place whose region holds the least IDF of an item's rarest words."""
    import numpy as np

    reach = [len(w) + STRIDE for w in items.words]
    count = items.ends[p.words + 1] - items.ends[p.words]
    before = np.append(0, np.cumsum(count))
    passages, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    doc, docs = 0, len(p.ends) - 1
    while doc < docs:  # whole documents of about EVENTS postings
        stop = max(doc + 1, int(np.searchsorted(before[p.ends], before[p.ends[doc]] + EVENTS, side="right")) - 1)
        a, b = p.ends[doc], p.ends[stop]
        doc = stop
        at = np.repeat(np.arange(a, b), count[a:b])
        item = items.holders[np.arange(before[a], before[b]) - before[at] + items.ends[p.words[at]]]
        group = p.owner[at] * len(reach) + item
        order = np.argsort(group, kind="stable")  # places stay in order
        at, group = at[order], group[order]
        weight = items.idf[p.words[at]]
        found, start = np.unique(group, return_index=True)
        if not len(found):
            continue
        ends = np.append(start, len(group))
        for g in np.flatnonzero(np.add.reduceat(weight, start) >= items.least[found % len(reach)]).tolist():
            owner, k = divmod(int(found[g]), len(reach))
            place, half = p.place[at[ends[g]:ends[g + 1]]], STRIDE + reach[k]
            sums = np.append(0, np.cumsum(weight[ends[g]:ends[g + 1]]))
            middle = np.arange(max(0, (place[0] - half) // STRIDE), min((place[-1] + half) // STRIDE, p.first[owner + 1] - p.first[owner] - 1) + 1)
            low, high = np.searchsorted(place, [middle * STRIDE - half, middle * STRIDE + half])
            middle = middle[sums[high] - sums[low] >= items.least[k]]
            passages.append(middle + p.first[owner])
            numbers.append(np.full(len(middle), k))
    passage, number = np.concatenate(passages), np.concatenate(numbers)
    order = np.lexsort((number, passage))
    return passage[order], number[order]


def find_matches(encoded: DataFrame, items: Items, cosine: float = COSINE) -> DataFrame:
    """(id, item number, kind, share, cosine, first_word, last_word), the best place of each document and item."""
    shared = encoded.sparkSession.sparkContext.broadcast(items)
    names = ["id", "item", "kind", "share", "cosine", "first_word", "last_word"]
    kinds = [None, pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches):
        import numpy as np

        it = shared.value
        keep = it.idf > 0
        reach = [len(w) + STRIDE for w in it.words]
        for part in _slices(batches):
            p = Passages(part)
            has, start, word, weight = _rows_of(p, it.idf, keep)
            passage, number = places_by_words(p, it)
            best: dict[tuple[int, int], tuple] = {}
            for a in range(0, max(len(has), 1), 4096):
                b = min(a + 4096, len(has))
                stop = start[b] if b < len(start) else len(word)
                first, last = has[a] if a else 0, has[b] if b < len(has) else p.n  # passages of this block, those without weight too
                x = _times(start[a:b] - start[a], word[start[a]:stop], weight[start[a]:stop], it.basis) if b else np.zeros((0, it.basis.shape[1]), np.float32)
                size = np.linalg.norm(x, axis=1)
                near = (x @ it.latent.T) / np.maximum(size, 1e-6)[:, None]
                rows, ks = np.nonzero(near >= cosine)
                lo, hi = np.searchsorted(passage, [first, last])
                places = np.unique(np.append(has[a + rows] * len(reach) + ks, passage[lo:hi] * len(reach) + number[lo:hi]))
                for here, k in zip(*(v.tolist() for v in np.divmod(places, len(reach)))):
                    doc = int(np.searchsorted(p.first, here, side="right")) - 1
                    middle = (here - int(p.first[doc])) * STRIDE
                    old = best.get((doc, k))
                    if old and old[3] >= 1:
                        continue
                    lo, hi = p.ends[doc], p.ends[doc + 1]
                    lo, hi = lo + np.searchsorted(p.place[lo:hi], [middle - STRIDE - reach[k], middle + STRIDE + reach[k]])
                    verdict = judge_match(it, k, p.words[lo:hi].tolist())
                    if verdict and (old is None or verdict[1] > old[3]):
                        row = int(np.searchsorted(has[a:b], here))
                        value = float(near[row, k]) if a + row < b and has[a + row] == here else 0.0
                        best[doc, k] = (doc, k, verdict[0], verdict[1], value, int(p.place[lo]), int(p.place[hi - 1]))
            if best:
                cols = list(zip(*best.values()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds[1:]))], names=names)

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"id {kind}, item long, kind string, share double, cosine double, first_word long, last_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: id_col, item_col, kind, share, cosine, first_word, last_word."""
    spark = docs.sparkSession
    item = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    item_type, id_type = item.schema["item_id"].dataType, docs.schema[id_col].dataType
    blocks = int((item.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // BLOCK_CHARS) + 1
    figures = ["kind", "share", "cosine", "first_word", "last_word"]
    private = ["__doc", "__item_id", *figures]
    result = spark.createDataFrame([], f"__doc {id_type.simpleString()}, __item_id {item_type.simpleString()}, kind string, share double, cosine double, first_word long, last_word long")
    for b in range(blocks):
        rows = item.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        items = Items(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is not None, r[0], r[1] or "")))
        if not items.ids:
            continue
        encoded = encode_documents(docs, items, id_col, text_col)
        items.fit(*document_frequencies(encoded, len(items.vocab)))
        items.project(latent_basis(encoded, items.idf, items=items))
        number = spark.createDataFrame(list(enumerate(items.ids)), f"item long, __item_id {item_type.simpleString()}")
        found = written(find_matches(encoded, items), "benchmark-matches").join(number, "item")
        result = result.unionByName(found.withColumnRenamed("id", "__doc").select(*private))
    return result.toDF(id_col, item_col, *figures)  # names may clash; places do not


@query("op2_benchmark_lsi")
def op2_benchmark_lsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
