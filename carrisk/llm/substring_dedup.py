"""Operator 3: substring dedup by line hashing.

Units are lines, and the sentences of lines that have several, so that a
passage pasted inside a line is found by its inner sentences.  A unit is
normalised (lower case, single blanks) and hashed to 128 bits.  Sentences inside
a line under ``min_words`` words and ``min_chars`` characters are too common to
tell anything and are left alone, and so are whole lines under ``LINE_WORDS``
words and ``LINE_CHARS`` characters.  Digests are grouped globally, the occurrence
that ranks first by (id, start) is kept, and all others are removed, with
their offsets in the original text retained.

A text's own repeats are settled where it is read, so a digest meets each
document once; ``min`` and ``min_by`` are summed before their shuffle, and a
digest held by a third of all documents is one row of the aggregate's side in
the join back (whose large side AQE may split).  Spans meet by document, which
bounds them by the text.  Units are made twice rather than stored: that costs
CPU but no disk.

Defined cases: null and empty texts have no units and stay; rows with equal
ids count as one document (each keeps its first occurrence); a null id is an
id of its own that ranks first; an empty table gives no rows; extra columns
are carried by ``dedup`` (one named like its spans is replaced) and ignored by
``repeated_units``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.llm.common import not_replaced, query, table, text_slices

MIN_WORDS = 6
MIN_CHARS = 60
LINE_WORDS, LINE_CHARS = 3, 11  # of whole lines
LINE = re.compile(r"[^\n]+")
SENTENCE = re.compile(r"\S.*?(?:[.!?]+(?=\s)|$)")


def text_units(text: str, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, int, str]]:
    """(start, length, normalised unit) of the lines of ``text`` and of the sentences in them."""
    for line in LINE.finditer(text):
        whole, at = line.group(), line.start()
        sentences = [(m.start(), m.group()) for m in SENTENCE.finditer(whole)]
        if not sentences:
            continue
        if len(sentences) > 1:
            first = sentences[0][0]
            sentences.append((first, whole[first:].rstrip()))
        for k, (offset, unit) in enumerate(sentences):
            words = unit.lower().split()
            line = k == len(sentences) - 1  # the whole one comes last
            if len(words) >= (min(min_words, LINE_WORDS) if line else min_words) or len(unit) >= (min(min_chars, LINE_CHARS) if line else min_chars):
                yield at + offset, len(unit), " ".join(words)


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, h1, h2, start, length, own): ``own`` is the start of the unit's first occurrence in its text, null in the first itself."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        for part in text_slices(batches, "__text"):
            rows, high, low, starts, lengths, own = [], [], [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                seen: dict[bytes, int] = {}
                for start, length, unit in text_units(text or "", min_words, min_chars):
                    digest = hashlib.blake2b(unit.encode(), digest_size=16).digest()
                    first = seen.setdefault(digest, start)
                    rows.append(i)
                    high.append(int.from_bytes(digest[:8], "little", signed=True))
                    low.append(int.from_bytes(digest[8:], "little", signed=True))
                    starts.append(start)
                    lengths.append(length)
                    own.append(None if first == start else first)
            ids = part.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(starts, pa.int32()),
                                              pa.array(lengths, pa.int32()), pa.array(own, pa.int32())],
                                             names=["id", "h1", "h2", "start", "length", "own"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, h1 long, h2 long, start int, length int, own int")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per removed occurrence: id, start, length, kept_id, kept_start."""
    every = units(docs, id_col, text_col, min_words, min_chars)
    # a null id ranks first: min() skips nulls, so it is counted beside it
    first = (every.where("own is null").groupBy("h1", "h2")
             .agg(F.min("id").alias("low"), F.min_by("start", "id").alias("low_start"), F.max(F.col("id").isNull()).alias("has_null"),
                  F.min(F.when(F.col("id").isNull(), F.col("start"))).alias("null_start"), F.count(F.lit(1)).alias("n"))
             .where("n > 1")
             .select("h1", "h2", F.when(~F.col("has_null"), F.col("low")).alias("kept_id"),
                     F.when(F.col("has_null"), F.col("null_start")).otherwise(F.col("low_start")).alias("kept_start"), F.lit(True).alias("shared")))
    gone = every.join(first, ["h1", "h2"], "left").where("own is not null or (shared and not (id <=> kept_id))")
    return gone.select("id", "start", "length", F.when(F.col("shared"), F.col("kept_id")).otherwise(F.col("id")).alias("kept_id"),
                       F.when(F.col("shared"), F.col("kept_start")).otherwise(F.col("own")).alias("kept_start"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "removed", how: str = "left",
          min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the rest of each text, and ``spans_col``: the removed (start, length, kept_id, kept_start), by start.

    ``how="inner"`` gives only the documents that lose something.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in not_replaced(docs.columns, [spans_col])])
    item = F.struct("start", "length", "kept_id", "kept_start")
    spans = (repeated_units(docs, id_col, text_col, min_words, min_chars).groupBy(F.col("id").alias("__id"))
             .agg(F.array_sort(F.collect_set(item)).alias(spans_col)))
    joined = docs.join(spans, docs[id_col].eqNullSafe(spans["__id"]), how)
    nothing = F.array().cast(spans.schema[spans_col].dataType)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("rest"))
    text = F.col(text_col)

    def cut(acc, s):  # spans may nest: a line and its sentences
        between = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["start"] + s["length"]).alias("at"), F.concat(acc["rest"], between).alias("rest"))

    rest = F.aggregate(F.col(spans_col), begin, cut, lambda acc: F.concat(acc["rest"], F.substring(text, acc["at"] + 1, F.length(text))))
    columns = [F.when(F.col(spans_col).isNull(), text).otherwise(rest).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(spans_col, nothing).alias(spans_col))


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that loses a unit, the documents that keep it, the spans and the rest of the text."""
    docs = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), how="inner")
    return docs.select("doc_id", F.size("removed").cast("long").alias("n_removed"),
                       F.array_sort(F.array_distinct("removed.kept_id")).alias("kept_doc_ids"), "removed", "text")
