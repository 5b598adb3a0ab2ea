"""Operator 7: quality rules as a bitmask ledger.

``ledger`` measures every text once, evaluates every rule once and stores the
measurements and one long of failure bits per row.  A policy is a version name
and the set of rules it enforces; ``apply_policy`` is one bitwise AND, and
``ablations`` counts, from the ledger's distinct masks alone, what each policy
would keep without each of its rules.  New policies never read the texts again.

Words are ``[^\\x20\\x09-\\x0D]+``.  Windows of eight words are named exactly
(ids of pairs, then of pairs of pairs, then of those), not hashed.

Rows: a null text has no words, fails ``few_words`` and gets measurements of
zero; repeated rows each give a row; rules divide by nothing that can be zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.llm.common import documents, map_texts

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "n_lines long, n_letters long, n_upper long")

# Each rule: name and SQL condition under which a text fails it.  A rule's bit
# is its place in the list; append new rules, never reorder.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 5 * n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    ("upper_case", "n_letters >= 50 AND 10 * n_upper > 6 * n_letters"),
    ("few_letters", "2 * n_letters < word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = [
    Policy("2025-base", BASE),
    Policy("2025-strict", tuple(BIT)),
    Policy("2026-production", (*BASE, "symbols", "duplicate_lines", "upper_case", "few_letters")),
]
PRODUCTION = POLICIES[-1]


def _name(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    return np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)[1]


def repeated_words(docs: list[list[bytes]]) -> list[int]:
    """Per document the words in 8-word windows found twice or more in it."""
    counts = np.array([len(d) for d in docs], np.int64)
    if not counts.size or counts.max() < WINDOW + 1:
        return [0] * len(docs)
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for d in docs for w in d), np.int64, counts.sum())
    for step in (1, 2, 4):
        ids = _name(ids[:-step], ids[step:])
    doc = np.repeat(np.arange(len(docs)), counts)
    ends = np.cumsum(counts)
    start = np.flatnonzero(np.arange(len(doc)) + WINDOW <= ends[doc])
    _, at, n = np.unique(doc[start] << 32 | ids[start], return_inverse=True, return_counts=True)
    twice = start[n[at] > 1]
    edges = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + WINDOW, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(docs)).tolist()


def _measure(texts: list[str]) -> list[pa.Array]:
    raw = [t.encode() for t in texts]
    words = [r.split() for r in raw]  # bytes split at exactly \x20 and \x09-\x0D
    dup, lines = [], []
    for r in raw:
        full = [x for x in r.split(b"\n") if x.strip(SPACES)]
        lines.append(len(full))
        dup.append(len(full) - len(set(full)))
    spaces = [len(r) - len(r.translate(None, SPACES)) for r in raw]
    columns = [
        [len(w) for w in words],
        [len(t) - s for t, s in zip(texts, spaces)],
        [len(r) - len(r.translate(None, SYMBOLS)) for r in raw],
        dup,
        repeated_words(words),
        lines,
        [_letters(t) for t in texts],
        [_uppers(t) for t in texts],
    ]
    return [pa.array(c, pa.int64()) for c in columns]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _letters(text: str) -> int:
    """A-Z, a-z and every code point from U+00C0 on."""
    p = _points(text)
    return int(np.count_nonzero(((p | 32) - 97 < 26) | (p >= 0xC0)))


def _uppers(text: str) -> int:
    """A-Z."""
    return int(np.count_nonzero(_points(text) - 65 < 26))


def failure_bits() -> Column:
    return sum((F.when(F.expr(cond), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
                for name, cond in RULES), F.lit(0).cast("long"))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements, fail_bits."""
    return map_texts(df, id_col, text_col, MEASURES, _measure).withColumn("fail_bits", failure_bits())


def apply_policy(book: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    return book.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(book: DataFrame, policies: list[Policy] | None = None) -> DataFrame:
    """version, without (a rule, null: none), n_docs, n_kept, and n_only: rows
    that this rule alone rejects.  Reads one row per distinct mask."""
    masks = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [(p.version, r, p.mask & ~BIT[r] if r else p.mask, BIT[r] if r else 0, p.mask)
             for p in policies or POLICIES for r in (None, *p.rules)]
    types = {"version": "string", "without": "string", "mask": "long", "bit": "long", "full_mask": "long"}
    grid = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(x, types.items())]) for x in cases])
    failing = F.col("fail_bits").bitwiseAND(F.col("mask"))
    only = (F.col("fail_bits").bitwiseAND(F.col("full_mask")) == F.col("bit")) & (F.col("bit") > 0)
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return (masks.select("fail_bits", "n", F.explode(grid).alias("c")).select("fail_bits", "n", "c.*")
            .groupBy("version", "without")
            .agg(F.sum("n").alias("n_docs"), total(failing == 0).alias("n_kept"), total(only).alias("n_only")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(documents(spark, sf_dir))
    base = F.col("fail_bits").bitwiseAND(F.lit(Policy("base", BASE).mask)) != 0
    return (apply_policy(book, PRODUCTION)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base.alias("base_failed"), "kept", "fail_bits"))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy keeps with and without each of its rules."""
    return ablations(ledger(documents(spark, sf_dir))).select(
        "version", F.coalesce("without", F.lit("-")).alias("without"), "n_docs", "n_kept", "n_only")


_BOOK_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY doc_id),
lines AS (SELECT d.doc_id, count(l.x) AS n_lines, count(l.x) - count(DISTINCT l.x) AS n_dup_lines
          FROM d LEFT JOIN (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) l
            ON d.doc_id = l.doc_id AND regexp_matches(l.x, '[^\\x20\\x09-\\x0D]') GROUP BY d.doc_id),
m AS (SELECT doc_id, len(ws) AS n_words,
             length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, n_lines,
             length(regexp_replace(t, '[^A-Za-z\\x{{C0}}-\\x{{10FFFF}}]', '', 'g')) AS n_letters,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
      FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
book AS (SELECT *, {" + ".join(f"CASE WHEN {c} THEN {BIT[n]} ELSE 0 END" for n, c in RULES)} AS fail_bits FROM m)
"""

QUERIES = {"op7_quality_rules": op7_quality_rules, "rule_ablations": rule_ablations}
ORACLE = {
    "op7_quality_rules": _BOOK_SQL + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {Policy("base", BASE).mask}) <> 0 AS base_failed, (fail_bits & {PRODUCTION.mask}) = 0 AS kept,
       CAST(fail_bits AS BIGINT) AS fail_bits
FROM book""",
    "rule_ablations": _BOOK_SQL + ", cases(version, without, mask, bit, full_mask) AS (VALUES " + ", ".join(
        f"('{p.version}', '{r or '-'}', {p.mask & ~BIT[r] if r else p.mask}, {BIT[r] if r else 0}, {p.mask})"
        for p in POLICIES for r in (None, *p.rules)) + """)
SELECT version, without, count(*) AS n_docs, CAST(sum(CASE WHEN (fail_bits & mask) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept,
       CAST(sum(CASE WHEN bit > 0 AND (fail_bits & full_mask) = bit THEN 1 ELSE 0 END) AS BIGINT) AS n_only
FROM book, cases GROUP BY version, without""",
}
