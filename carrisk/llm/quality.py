"""Operator 8: quality rules as a short-circuit cascade.

Every rule is a boolean test on measured figures of a whole text.  On a hash
sample of about ``SAMPLE_ROWS`` texts the operator measures what each rule's
figures cost and what share of texts it rejects, and orders the rules by
rejection per cost; in each task a rule is then evaluated only for the texts
that all rules before it kept.  A text's verdict is the conjunction of all
rules, so the order changes cost and ``failed_rule`` (the first rule that
rejected it) but never ``kept``.

The four base figures are part of the output and measured for every text.
Words are ``[^\\x20\\x09-\\x0D]+``.  Python inside ``mapInArrow`` slices of a
million bytes; no shuffle.

Defined cases: null and empty texts have no words (all figures 0) and fail
``n_words < min_words``; every row gives one row, repeats included; an empty
table gives none; a kept input column with an output's name is replaced by it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrisk.llm.common import not_replaced, query, table, text_slices

SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"


class Figures:
    """Figures of a slice of texts, each measured once and only when a rule asks for it."""

    def __init__(self, texts: Sequence[str]):
        import numpy as np
        import pyarrow.compute as pc

        self.np, self.pc, self.n = np, pc, len(texts)
        self.texts = pa.array(texts, pa.large_string())
        self._made: dict[str, object] = {}

    def __getitem__(self, name: str):
        if name not in self._made:
            self._made[name] = getattr(self, name)()
        return self._made[name]

    def words(self):
        """(flat words, owner of each)."""
        pc, np = self.pc, self.np
        lists = pc.ascii_split_whitespace(self.texts)
        flat, owner = lists.flatten(), pc.list_parent_indices(lists)
        real = pc.greater(pc.binary_length(flat), 0)
        return flat.filter(real), owner.filter(real).to_numpy().astype(np.int64)

    def per_text(self, owner, weights=None):
        return self.np.bincount(owner, weights, self.n).astype(self.np.int64)

    def n_words(self):
        return self.per_text(self["words"][1])

    def word_chars(self):
        flat, owner = self["words"]
        return self.per_text(owner, self.pc.utf8_length(flat).to_numpy())

    def n_symbols(self):
        return self.pc.count_substring_regex(self.texts, pattern="[" + SYMBOLS + "]").to_numpy().astype(self.np.int64)

    def word_ids(self):
        """A number for each word, the same for equal words of this slice."""
        return self["words"][0].dictionary_encode().indices.to_numpy().astype(self.np.int64)

    def n_repeat_words(self):
        """Words in a window of three that occurs twice or more in its text."""
        np = self.np
        ids, owner = self["word_ids"], self["words"][1]
        if len(ids) < 3:
            return np.zeros(self.n, np.int64)
        n_ids = int(ids.max()) + 1
        inside = owner[:-2] == owner[2:]  # a window over a text's end is none
        pair = np.unique(owner[:-2] * n_ids + ids[:-2], return_inverse=True)[1]  # text and first word
        pair = np.unique(pair.astype(np.int64) * n_ids + ids[1:-1], return_inverse=True)[1]
        window = np.unique(pair.astype(np.int64) * n_ids + ids[2:], return_inverse=True)[1]
        twice = inside & (np.bincount(window[inside], minlength=len(window))[window] > 1)
        hit = np.zeros(len(ids), bool)
        for k in range(3):
            hit[k:len(ids) - 2 + k] |= twice
        return self.per_text(owner, hit)

    def lines(self):
        """(flat lines that hold a word, owner of each)."""
        pc, np = self.pc, self.np
        lists = pc.split_pattern(self.texts, "\n")
        flat, owner = lists.flatten(), pc.list_parent_indices(lists)
        real = pc.greater(pc.binary_length(pc.ascii_trim(flat, characters="\t\n\v\f\r ")), 0)
        return flat.filter(real), owner.filter(real).to_numpy().astype(np.int64)

    def n_lines(self):
        return self.per_text(self["lines"][1])

    def n_dup_lines(self):
        np = self.np
        flat, owner = self["lines"]
        if not len(flat):
            return np.zeros(self.n, np.int64)
        ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
        key = owner * (int(ids.max()) + 1) + ids
        distinct = owner[np.unique(key, return_index=True)[1]]
        return self.per_text(owner) - self.per_text(distinct)

    def n_alpha_words(self):
        """Words with a letter."""
        flat, owner = self["words"]
        return self.per_text(owner, self.pc.match_substring_regex(flat, pattern=r"\p{L}").to_numpy(zero_copy_only=False))

    def n_marked_lines(self):
        """Lines that start like a list item."""
        flat, owner = self["lines"]
        return self.per_text(owner, self.pc.match_substring_regex(flat, pattern=r"^[ \t]*[-*•]").to_numpy(zero_copy_only=False))

    def n_cut_lines(self):
        """Lines that end in an ellipsis."""
        flat, owner = self["lines"]
        return self.per_text(owner, self.pc.match_substring_regex(flat, pattern=r"(?:\.\.\.|…)[ \t\r]*$").to_numpy(zero_copy_only=False))


@dataclass(frozen=True)
class Rule:
    """``rejects(figures)`` gives a boolean array: True where the text goes."""

    name: str
    rejects: Callable[[Figures], object] = field(repr=False)


def default_rules(min_words: int = 50, max_repeat_pct: int = 50, max_symbol_pct: int = 10, mean_chars: tuple[int, int] = (2, 14),
                  max_dup_line_pct: int = 30, min_alpha_pct: int = 60, max_marked_pct: int = 90, max_cut_pct: int = 30) -> list[Rule]:
    """The base rules first, then rules on symbols, word length, lines and letters (integer arithmetic only)."""
    return [
        Rule("few_words", lambda f: f["n_words"] < min_words),
        Rule("repeated_words", lambda f: 100 * f["n_repeat_words"] > max_repeat_pct * f["n_words"]),
        Rule("symbols", lambda f: 100 * f["n_symbols"] > max_symbol_pct * f["n_words"]),
        Rule("word_length", lambda f: (f["word_chars"] < mean_chars[0] * f["n_words"]) | (f["word_chars"] > mean_chars[1] * f["n_words"])),
        Rule("repeated_lines", lambda f: 100 * f["n_dup_lines"] > max_dup_line_pct * f["n_lines"]),
        Rule("letters", lambda f: 100 * f["n_alpha_words"] < min_alpha_pct * f["n_words"]),
        Rule("list_items", lambda f: 100 * f["n_marked_lines"] > max_marked_pct * f["n_lines"]),
        Rule("ellipses", lambda f: 100 * f["n_cut_lines"] > max_cut_pct * f["n_lines"]),
    ]


def _texts(part: pa.RecordBatch) -> list[str]:
    return [t or "" for t in part.column(part.num_columns - 1).to_pylist()]


def sample_limit(total: int, sample_rows: int) -> int:
    """The largest row hash of 0 to 2^63 - 1 that is in a sample of about ``sample_rows`` of ``total`` rows."""
    return (1 << 63) * min(sample_rows, total) // max(total, 1) - 1 if total else -1


def order_rules(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of ``rules`` by rejection per cost, measured on a hash sample of about ``sample_rows`` texts."""
    named = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # no hash of a map
    row_hash = F.xxhash64(*named).bitwiseAND(F.lit((1 << 63) - 1))
    sample = docs.select(F.col(text_col).cast("string").alias("__text"), row_hash.alias("__hash")).where(F.col("__hash") <= sample_limit(docs.count(), sample_rows)).select("__text")
    schema = T.StructType([T.StructField("rule", T.StringType()), T.StructField("n", T.LongType()),
                           T.StructField("rejected", T.LongType()), T.StructField("seconds", T.DoubleType())])

    def run(batches):
        for part in text_slices(batches, "__text"):
            for rule in rules:
                figures = Figures(_texts(part))
                if rule.name != "few_words":
                    figures["words"]  # split once for all rules: not a rule's own cost
                began = time.perf_counter()
                gone = int(rule.rejects(figures).sum())
                row = [[rule.name], [part.num_rows], [gone], [time.perf_counter() - began]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=schema.names)

    measured = {r.rule: r for r in sample.mapInArrow(run, schema).groupBy("rule").agg(
        F.sum("n").alias("n"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect()}

    def gain(name: str) -> float:
        r = measured.get(name)
        return (r.rejected + 0.5) / (r.n + 1) / max(r.seconds / max(r.n, 1), 1e-9) if r else 0.0

    return sorted((r.name for r in rules), key=gain, reverse=True)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(docs: DataFrame, rules: Sequence[Rule] | None = None, text_col: str = "text", keep: Sequence[str] = ("doc_id",),
                with_base: bool = True, sample_rows: int = SAMPLE_ROWS, kept_col: str = "kept", failed_col: str = "failed_rule") -> DataFrame:
    """``keep`` + [base figures] + ``kept_col`` and ``failed_col`` (null where kept)."""
    rules = list(default_rules() if rules is None else rules)
    place = {name: i for i, name in enumerate(order_rules(docs, rules, text_col, sample_rows))}
    ordered = sorted(rules, key=lambda r: place[r.name])
    base = BASE if with_base else ()
    keep = not_replaced(keep, (*base, kept_col, failed_col))
    schema = T.StructType([*(docs.schema[k] for k in keep), *(T.StructField(b, T.LongType(), False) for b in base),
                           T.StructField(kept_col, T.BooleanType(), False), T.StructField(failed_col, T.StringType())])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]):
        import numpy as np

        for part in text_slices(batches, "__text"):
            texts = _texts(part)
            figures = Figures(texts)
            measured = [pa.array(figures[b], pa.int64()) for b in base]
            failed = np.full(len(texts), None, object)
            have = left = np.arange(len(texts))  # texts that ``figures`` covers; texts not rejected so far
            for rule in ordered:
                if not len(left):
                    break
                if 2 * len(left) < len(have):
                    have, figures = left, Figures([texts[i] for i in left])
                gone = np.asarray(rule.rejects(figures))[np.searchsorted(have, left)]
                failed[left[gone]] = rule.name
                left = left[~gone]
            verdict = pa.array(failed.tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], *measured, verdict.is_null(), verdict], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM
      (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM c WHERE n > 1) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: regexp_matches(x, '\\p{L}'))) AS n_alpha,
             len(list_filter(ls, lambda l: regexp_matches(l, '^[ \\t]*[-*•]'))) AS n_marked,
             len(list_filter(ls, lambda l: regexp_matches(l, '(\\.\\.\\.|…)[ \\t\\r]*$'))) AS n_cut
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= 10 * n_words AND word_chars >= 2 * n_words AND word_chars <= 14 * n_words
       AND 100 * n_dup_lines <= 30 * n_lines AND 100 * n_alpha >= 60 * n_words
       AND 100 * n_marked <= 90 * n_lines AND 100 * n_cut <= 30 * n_lines AS kept
FROM b
"""


@query("op8_quality_cascade", ORACLE_SQL)
def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *BASE, failed.alias("base_failed"), "kept")
