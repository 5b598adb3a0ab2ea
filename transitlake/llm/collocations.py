"""Operator 13: phrase collocations by SETM, set-oriented relational mining.

1. The occurrence relation of length 1 is written once: a text falls at
   punctuation and line ends into pieces and those into words, and every word
   is an occurrence (position, group), sorted by position.  Positions count on
   through a block of texts and every piece break takes one, so neighbours in
   a piece are exactly the occurrences at adjacent positions.
2. Per length: occurrences are counted by group (phrase) within a block, then
   over the corpus; the relation is cut to the groups that occur ``min_count``
   times or more by a semi-join and written; and it is merge-joined at the next
   position: words with every following word, longer phrases, which overlap in
   all but a word, with themselves.  (A phrase is frequent only if its beginning
   and its end are.)
3. Scores, cuts and containment are joins of the small tables of frequent
   groups.

A block is a row: texts of one language, about ``block_bytes`` in all, its relation,
sorted and packed, and its distinct groups with their counts.  So what is
shuffled for counting is one row per block and distinct group, however often a
hot phrase occurs.  The frequent groups reach the blocks as a broadcast where
their measured size is at most ``max_broadcast`` bytes, else by a shuffled join of
the blocks' groups; both give the same relation.  A text longer than a block is cut between pieces, a piece
longer than that between words, with the next ``max_words - 1`` words as
context that is matched but not counted.

Rows: null texts are empty, a null language is ``und``, repeated rows count
each time, other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transitlake.llm.common import bounded_batches, discard, documents, write_table

BREAKS = b".,;:!?\n\x0b\x0c\r"
BREAK = b"."
# A-Z stay here (bytes.lower turns them), a break is a point, a tab a space
NORMAL = bytes.maketrans(BREAKS + b"\t", BREAK * len(BREAKS) + b" ")
# occurrences: the sorted relation of a block, positions (as gaps, mostly 1) and groups, see ``packed``
# kept: the groups numbered below it are known as frequent
RELATION = "block long, lang string, owned int, kept int, occurrences binary, phrases array<string>, counts array<long>"
FIELDS = [f.split()[0] for f in RELATION.split(", ")]
SALTS = 64


def windows(data: bytes, size: int, context: int) -> Iterator[tuple[bytes, bytes]]:
    """Cut ``data`` into parts of about ``size`` bytes, at a break where there
    is one, else between words; with each part the ``context`` words behind."""
    behind = re.compile(rb"(?: +[^ ]+){0,%d}" % context)
    start = 0
    while len(data) - start > size:
        cut = data.rfind(BREAK, start, start + size)
        if cut > start:
            yield data[start:cut], b""
            start = cut + 1
            continue
        cut = data.find(b" ", start + size)
        if cut < 0:
            break
        yield data[start:cut], behind.match(data, cut)[0]
        start = cut
    yield data[start:], b""


def packed(pos: np.ndarray, gid: np.ndarray) -> bytes:
    """A relation in a fraction of its size: gaps between positions and groups
    as 32-bit numbers, byte plane by byte plane, compressed."""
    both = np.concatenate([np.diff(pos, prepend=0), gid]).astype("<i4")
    planes = np.ascontiguousarray(both.view("u1").reshape(-1, 4).T)
    return len(planes[0]).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), "u1").reshape(4, n)
    gap, gid = np.ascontiguousarray(planes.T).view("<i4").reshape(2, -1)
    return np.cumsum(gap, dtype="i8"), gid


def relation_of(own: bytes, context: bytes) -> dict:
    """The sorted occurrence relation of one block: positions, groups, and per
    group its word and how often it occurs among the block's own words."""
    spaced = lambda b: b.replace(BREAK, b" . ").split()
    words = spaced(own)
    owned = len(words)
    coded = pa.array(words + spaced(context), pa.binary()).dictionary_encode()
    codes, groups = coded.indices.to_numpy(), coded.dictionary
    at_break = pc.index(groups, pa.scalar(BREAK, pa.binary())).as_py()
    pos = np.flatnonzero(codes != at_break)
    counts = np.bincount(codes[:owned], minlength=len(groups))
    if at_break >= 0:
        counts[at_break] = 0
    return {"owned": owned, "kept": 0, "occurrences": packed(pos, codes[pos]), "phrases": groups.cast(pa.string()), "counts": counts}


def restricted(row: dict, frequent: np.ndarray, drop: bool) -> dict:
    """A relation whose frequent groups come first; ``drop`` the others."""
    order = np.argsort(~frequent, kind="stable")
    place = np.empty(len(order), "i8")
    place[order] = np.arange(len(order))
    kept = int(frequent.sum())
    pos, gid = unpacked(row["occurrences"])
    gid = place[gid]
    if drop:
        pos, gid, order = pos[gid < kept], gid[gid < kept], order[:kept]
    return row | {"kept": kept, "occurrences": packed(pos, gid), "phrases": row["phrases"].take(pa.array(order)), "counts": row["counts"][order]}


def extended(row: dict) -> dict | None:
    """Merge-join of a relation with itself at the next position, the first
    occurrence in a frequent group; None if there is none."""
    (pos, gid), phrases, n = unpacked(row["occurrences"]), row["phrases"], len(row["phrases"])
    first = np.flatnonzero((pos[1:] == pos[:-1] + 1) & (gid[:-1] < row["kept"]))
    if not len(first):
        return None
    pair, made = np.unique(gid[first].astype("i8") * n + gid[first + 1], return_inverse=True)
    last_words = pc.replace_substring_regex(phrases, "^.* ", "")
    joined = pc.binary_join_element_wise(phrases.take(pa.array(pair // n)), last_words.take(pa.array(pair % n)), " ")
    counts = np.bincount(made[pos[first] < row["owned"]], minlength=len(pair))
    return row | {"kept": 0, "occurrences": packed(pos[first], made), "phrases": joined, "counts": counts}


def _batch(row: dict) -> pa.RecordBatch:
    """A relation as a batch of the schema RELATION."""
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    kinds = {"block": pa.int64(), "lang": pa.string(), "owned": pa.int32(), "kept": pa.int32(), "occurrences": pa.binary()}
    return pa.RecordBatch.from_arrays([*(pa.array([row[c]], k) for c, k in kinds.items()), one(row["phrases"]),
                                       one(pa.array(row["counts"], pa.int64()))], names=FIELDS)


def _relations(batches) -> Iterator[tuple[dict, pa.RecordBatch]]:
    """The relations of batches, each with its batch of one row."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            row = {c: one.column(c)[0].as_py() for c in FIELDS[:5]}
            yield row | {"phrases": one.column("phrases")[0].values, "counts": one.column("counts")[0].values.to_numpy()}, one


def word_relation(df: DataFrame, text_col: str, lang_col: str, max_words: int, block_bytes: int) -> DataFrame:
    """The occurrence relation of single words, one row per block."""
    bounded_batches(df.sparkSession)

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def block(lang, own, context=b""):
            nonlocal made
            made += 1
            return _batch({"block": (task << 33) + made, "lang": lang} | relation_of(own, context))

        def flush(langs):
            for key in langs:
                sizes.pop(key)
                yield block(key, BREAK.join(held.pop(key)))

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode().lower().translate(NORMAL)
                *long, (rest, _) = windows(data, block_bytes, max_words - 1)
                for own, context in long:
                    yield block(lang, own, context)
                held.setdefault(lang, []).append(rest)
                sizes[lang] = sizes.get(lang, 0) + len(rest) + 64
                if sizes[lang] >= block_bytes:
                    yield from flush([lang])
            if sum(sizes.values()) >= 3 * block_bytes:
                yield from flush(list(sizes))
        yield from flush(list(sizes))

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return df.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, RELATION)


def groups(relation: DataFrame) -> DataFrame:
    """block, lang, gid, phrase, count of every distinct group of every block."""
    zipped = F.arrays_zip("phrases", "counts")
    return (relation.select("block", "lang", F.posexplode(zipped).alias("gid", "g"))
            .select("block", "lang", "gid", F.col("g.phrases").alias("phrase"), F.col("g.counts").alias("count")))


def frequent(relation: DataFrame, min_count: int) -> DataFrame:
    """lang, phrase, f of the groups that occur ``min_count`` times or more."""
    return groups(relation).groupBy("lang", "phrase").agg(F.sum("count").alias("f")).where(F.col("f") >= min_count)


def semi_join(relation: DataFrame, table: DataFrame, drop: bool, max_broadcast: int) -> DataFrame:
    """The relation with the groups of ``table`` first; ``drop`` the others."""
    size = table.agg(F.sum(F.octet_length("phrase") + F.octet_length("lang") + 8)).first()[0] or 0
    if size <= max_broadcast:
        local = table.select("lang", "phrase").toArrow()
        langs = local.column("lang").unique().to_pylist()
        known = relation.sparkSession.sparkContext.broadcast(
            {g: local.filter(pc.equal(local.column("lang"), g)).column("phrase").combine_chunks() for g in langs})

        def look_up(batches):
            none = pa.array([], pa.string())
            for row, _ in _relations(batches):
                frequent = pc.is_in(row["phrases"], value_set=known.value.get(row["lang"], none))
                yield _batch(restricted(row, frequent.to_numpy(zero_copy_only=False), drop))

        return relation.mapInArrow(look_up, RELATION)
    found = (groups(relation).join(table.select("lang", "phrase"), ["lang", "phrase"])
             .groupBy("block").agg(F.collect_list("gid").alias("found")))

    def restrict(batches):
        for row, one in _relations(batches):
            frequent = np.zeros(len(row["phrases"]), bool)
            if one.column("found")[0].is_valid:
                frequent[one.column("found")[0].values.to_numpy()] = True
            yield _batch(restricted(row, frequent, drop))

    return relation.join(found, "block", "left").select(*FIELDS, "found").mapInArrow(restrict, RELATION)


def merge_join(relation: DataFrame) -> DataFrame:
    """The occurrences of the next length, not counted yet."""
    def run(batches):
        for row, _ in _relations(batches):
            if longer := extended(row):
                yield _batch(longer)

    return relation.mapInArrow(run, RELATION)


def frequent_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, max_words: int = 5,
                     block_bytes: int = 3 << 20, max_broadcast: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, f) of all phrases of up to ``max_words`` words
    that occur ``min_count`` times or more, and (lang, n) of all words."""
    first = occurrences = write_table(word_relation(df, text_col, lang_col, max_words, block_bytes), "setm", "zstd")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    words = write_table(first.groupBy("lang").agg(F.sum(total).alias("n")), "setm-words")
    tables, read = [], first
    for k in range(1, max_words + 1):
        table = write_table(frequent(occurrences, min_count), f"setm-frequent-{k}", "zstd")
        tables.append(table.select("lang", "phrase", F.lit(k).alias("n_words"), "f"))
        if k < max_words:
            relation = write_table(semi_join(occurrences, table, k > 1, max_broadcast), f"setm-{k}", "zstd")
            occurrences = merge_join(relation)
        discard(read)
        read = relation
    return reduce(DataFrame.union, tables), words


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of two words or more,
    by its lowest-scoring cut.  Products are exact decimals of 38 digits."""
    number = lambda c: F.col(c).cast("decimal(19,0)")
    w = F.split("phrase", " ", -1)
    cut = lambda start, length: F.array_join(F.slice(w, start, length), " ")
    cuts = (phrases.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"),
                                                F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
            .select("*", cut(F.lit(1), F.col("k")).alias("head"), cut(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("tail")))
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(words, "lang")
    cuts = cuts.withColumns({"up": (number("a") * F.lit(1000)).cast("decimal(19,0)") * number("n"), "down": number("l") * number("r")})
    lowest = F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r", "n", "a"))
    return cuts.groupBy("lang", "phrase").agg(lowest.alias("m")).select("lang", "phrase", "m.a", "m.l", "m.r", "m.n", "m.score")


def contained(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a of phrases inside a longer frequent one that occurs as
    often.  One that is as often inside any longer phrase is as often inside
    one that is a word longer, so those alone are read."""
    inner = F.array(F.regexp_replace("phrase", " [^ ]+$", ""), F.regexp_replace("phrase", "^[^ ]+ ", ""))
    return (phrases.where("n_words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("a")).distinct())


def top_collocations(df: DataFrame, top: int = 2000, **params) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top``."""
    phrases, words = frequent_phrases(df, **params)
    rows = scored(phrases, words).join(contained(phrases), ["lang", "phrase", "a"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))  # a hot language is ranked in parts first
    rows = rows.withColumn("part", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("part") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return (rows.withColumn("rank", rank).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_collocations(documents(spark, sf_dir, "lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM listed GROUP BY lang),
starts AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM listed, range(1, 6) t(k)),
freq AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS len, count(*) AS f
  FROM starts GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, n, c.k,
    (CAST(1000 AS HUGEINT) * c.f * n) // (CAST(h.f AS HUGEINT) * t.f) AS score
  FROM (SELECT *, unnest(range(1, len)) AS k, string_split(phrase, ' ') AS w FROM freq WHERE len > 1) c
  JOIN freq h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN freq t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.k + 1:], ' ')
  JOIN words ON words.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
open AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM freq x WHERE x.lang = b.lang AND x.f = b.a AND x.phrase <> b.phrase
      AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM open)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""

QUERIES = {"op13_collocations": op13_collocations}
ORACLE = {"op13_collocations": SQL}
