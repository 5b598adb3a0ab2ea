"""Operator 4: removal of repeated line runs by a distributed suffix array.

Every text is its sequence of lines (blank ones left aside).  A run of
consecutive lines of at least ``min_words`` words that also occurs earlier
(smaller id, then earlier in the text) is deleted; the first copy stays.

1. Line ids: 128 bits of hash per line; lines that occur once break the
   sequences, as no repeated run holds them.
2. Prefix doubling: rank k of a position orders the runs of 2^k lines that
   start there.  Rank k+1 is the order of the pairs (rank k here, rank k 2^k
   lines on), found by a range-partitioned sort of the distinct repeated pairs;
   a pair that occurs once starts no repeated run and is dropped.
3. Intervals: suffixes whose longest common prefix has at least l lines are
   those with equal ranks k = floor(log2 l) at their start and at l - 2^k.  The
   interval's smallest position is the copy that stays.

Which runs: let W(p) be the shortest run from line p on, and V(e) the shortest
run up to line e, with ``min_words`` words.  Any repeated run with so many
words is exactly the union of the W and V inside it (from its last V leftward
every line starts a W that ends inside), and W and V depend on their own lines
only.  So it is enough, and exact, to look up the intervals of all W and V;
their union are the maximal repeated runs.  As every line has a word, W and V
have at most ``min_words`` lines, which bounds the doublings.

Rows: null and empty texts have no lines and stay as they are; repeated rows
and repeated or null ids are told apart by a row number (nulls come first);
extra columns are carried by ``clean``, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transitlake.llm.common import bounded_batches, documents, shielded, text_slices, write_table

SPACE = " \t\n\x0b\x0c\r"
MIN_WORDS = 30


def line_table(marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__row, id, seq (number among lines with words), n_words, h1, h2."""
    lines = F.transform(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)))
    rows = (marked.select("__row", F.col(id_col).alias("id"), F.filter(lines, lambda x: x != "").alias("lines"))
            .select("__row", "id", F.posexplode_outer("lines").alias("seq", "line")).where(F.col("line").isNotNull()))
    return rows.select("__row", "id", "seq", F.size(F.split("line", "[ \\t-\\r]+")).alias("n_words"),
                       F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def _ranked(classes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct ``keys`` with ``rank``, a long in their sort order."""
    return write_table(classes.repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .select(*keys, F.monotonically_increasing_id().alias("rank")), name)


def suffix_ranks(lines: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """(positions with repeated lines, ranks): ranks has level, __row, seq,
    rank of every repeated run of 2^level lines."""
    repeated = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    ids = _ranked(repeated, ["h1", "h2"], "line-ids")
    level = write_table(lines.join(ids, ["h1", "h2"]).select("__row", "id", "seq", "n_words", "rank"), "line-ranks-0")
    positions, ranks = level.drop("rank"), level.select(F.lit(0).alias("level"), "__row", "seq", "rank")
    level = level.select("__row", "seq", "rank")
    for k in range(levels):
        step = 1 << k
        ahead = Window.partitionBy("__row").orderBy("seq")
        # runs that were dropped leave gaps, so look the partner up by its line number
        pairs = (level.withColumn("next", F.max(F.struct("seq", "rank")).over(ahead.rangeBetween(step, step)))
                 .where(F.col("next").isNotNull()).select("__row", "seq", F.col("rank").alias("left"), F.col("next.rank").alias("right")))
        repeated = pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("left", "right")
        ids = _ranked(repeated, ["left", "right"], "run-ids")
        level = write_table(pairs.join(ids, ["left", "right"]).select("__row", "seq", "rank"), f"line-ranks-{k + 1}")
        ranks = ranks.union(level.select(F.lit(k + 1).alias("level"), "__row", "seq", "rank"))
    return positions, ranks


def _shortest_runs(seq: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """(start, length) of every W and V among one text's positions."""
    out = []
    for part in np.split(np.arange(len(seq)), np.flatnonzero(np.diff(seq) != 1) + 1):
        total = np.concatenate([[0], np.cumsum(words[part])])
        end = np.searchsorted(total, total[:-1] + least)  # W: first end with enough words
        has = end < len(total)
        out.append(np.stack([seq[part[0]] + np.flatnonzero(has), (end - np.arange(len(part)))[has]], 1))
        start = np.searchsorted(total, total[1:] - least, "right") - 1  # V: last start with enough words
        has = start >= 0
        out.append(np.stack([seq[part[0]] + start[has], (np.arange(1, len(part) + 1) - start)[has]], 1))
    return np.unique(np.concatenate(out), axis=0)


def candidate_runs(positions: DataFrame, min_words: int) -> DataFrame:
    """__row, id, start, length of every W and V."""
    grouped = positions.groupBy("__row", "id").agg(F.sort_array(F.collect_list(F.struct("seq", "n_words"))).alias("x"))
    grouped = grouped.select("__row", F.col("x.seq").alias("seq"), F.col("x.n_words").alias("n_words"))

    def run(batches):
        for batch in batches:
            rows, found = [], [np.empty((0, 2), np.int64)]
            for row, seq, words in zip(*(batch[c] for c in ("__row", "seq", "n_words"))):
                runs = _shortest_runs(np.asarray(seq.values), np.asarray(words.values), min_words)
                found.append(runs)
                rows.append(np.full(len(runs), row.as_py()))
            both = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)),
                                              pa.array(both[:, 0].astype(np.int32)), pa.array(both[:, 1].astype(np.int32))],
                                             names=["__row", "start", "length"])

    return grouped.mapInArrow(run, "__row long, start int, length int")


def repeated_runs(marked: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """__row, __runs: array of (start, length) of the lines to delete."""
    lines = write_table(line_table(marked, id_col, text_col), "lines")
    positions, ranks = suffix_ranks(lines, max(0, min_words.bit_length() - 1))
    k = F.floor(F.log2("length") + 1e-9).cast("int")
    runs = candidate_runs(positions, min_words).withColumn("level", k)
    runs = runs.withColumn("tail", (F.col("start") + F.col("length") - F.expr("shiftleft(1, level)")).cast("int"))
    at = lambda seq, out: ranks.select("level", "__row", F.col("seq").alias(seq), F.col("rank").alias(out))
    keyed = (runs.join(at("start", "a"), ["__row", "level", "start"]).join(at("tail", "b"), ["__row", "level", "tail"])
             .join(positions.select("__row", "id", F.col("seq").alias("start")), ["__row", "start"]))
    place = F.struct(F.col("id"), F.col("__row"), F.col("start"))
    keyed = write_table(keyed.select("__row", "start", "length", "a", "b", place.alias("place")), "line-runs")
    firsts = write_table(keyed.groupBy("length", "a", "b").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
                         .where("n > 1").drop("n"), "first-runs")
    later = keyed.join(firsts, ["length", "a", "b"]).where(~F.col("place").eqNullSafe(F.col("first")))
    return write_table(later.groupBy("__row").agg(F.collect_list(F.struct("start", "length")).alias("__runs")), "later-runs")


def _without(text: str, runs: list[dict]) -> tuple[str, int, int, int]:
    """(text left, lines with words, deleted lines, maximal deleted runs)."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip(SPACE)]
    gone = np.zeros(len(full) + 1, np.int64)
    for r in runs:
        gone[r["start"]] += 1
        gone[r["start"] + r["length"]] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    drop = {full[i] for i in np.flatnonzero(gone)}
    return ("\n".join(x for i, x in enumerate(lines) if i not in drop), len(full), len(drop),
            int(np.count_nonzero(np.diff(gone, prepend=False) & gone)))


def _cleaned(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """``df``'s columns, __text, __n_lines, __n_removed, __n_runs; a row each."""
    bounded_batches(df.sparkSession)
    marked = write_table(df.withColumn("__row", F.monotonically_increasing_id()), "line-dedup-input")
    runs = repeated_runs(marked, id_col, text_col, min_words).hint("merge")  # as many rows as changed texts: never broadcast
    joined = (marked.join(runs, "__row", "left").drop("__row")
              .withColumn("__text", F.col(text_col).cast("string")))
    place = joined.columns.index("__text")
    names = [*joined.columns, "__n_lines", "__n_removed", "__n_runs"]
    names.remove("__runs")
    fields = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns),
                        "__text string, __n_lines long, __n_removed long, __n_runs long"])

    def run(batches):
        for part, texts in text_slices(batches, place):
            done = [_without(t, r or []) for t, r in zip(texts, part.column("__runs").to_pylist())]
            given = part.column("__text")
            left = pa.array([d[0] if d[2] else (g if g is None else t) for d, t, g in
                             zip(done, texts, given.to_pylist())], pa.string())
            columns = [left if c == "__text" else part.column(c) for c in names[:-3]]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2, 3))],
                                             names=names)

    return joined.mapInArrow(run, fields)


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with later copies deleted from its texts; texts that had words
    and have none left are dropped as rows."""
    own, now, restore = shielded(df)
    rows = _cleaned(own, now[id_col], now[text_col], min_words).where("__n_removed < __n_lines or __n_lines = 0")
    return restore(rows.select(*[F.col("__text").alias(c) if c == now[text_col] else F.col(c) for c in own.columns]))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cleaned(documents(spark, sf_dir), "doc_id", "text", MIN_WORDS)
    return rows.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"),
                       F.col("__n_runs").alias("n_runs"), F.sha2(F.coalesce("__text", F.lit("")), 256).alias("kept_sha256"))


_SQL = f"""
WITH raw AS (SELECT doc_id, u.x, u.i FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS u(x, i)),
l AS (SELECT doc_id, i, x, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line,
             row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq
      FROM raw WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
c AS (SELECT *, sum(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY seq) AS upto,
             len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM l),
ends AS (SELECT a.doc_id, a.seq AS s, min(b.seq) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.seq >= a.seq
         AND b.seq < a.seq + {MIN_WORDS} AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY ALL
         UNION
         SELECT b.doc_id, max(a.seq) AS s, b.seq AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.seq >= a.seq
         AND b.seq < a.seq + {MIN_WORDS} AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY b.doc_id, b.seq),
runs AS (SELECT w.doc_id, s, e, string_agg(line, chr(10) ORDER BY seq) AS t FROM ends w JOIN c ON c.doc_id = w.doc_id
         AND seq BETWEEN s AND e GROUP BY w.doc_id, s, e),
later AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS r FROM runs) WHERE r > 1),
gone AS (SELECT DISTINCT c.doc_id, c.seq, c.i FROM c JOIN later w ON c.doc_id = w.doc_id AND c.seq BETWEEN w.s AND w.e),
starts AS (SELECT g.doc_id, count(*) AS n_removed,
                  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM gone h WHERE h.doc_id = g.doc_id AND h.seq = g.seq - 1)) AS n_runs
           FROM gone g GROUP BY g.doc_id),
kept AS (SELECT raw.doc_id, string_agg(raw.x, chr(10) ORDER BY raw.i) AS t FROM raw
         WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = raw.doc_id AND g.i = raw.i) GROUP BY raw.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN starts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE = {"op4_line_dedup": _SQL}
