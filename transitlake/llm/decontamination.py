"""Operator 9: benchmark decontamination by SimHash of item-sized windows.
DataFrame functions only.

A benchmark item of n words leaks into a text if some window of the text of n
words has a weighted Jaccard similarity (multisets of word 5-shingles) of at
least ``min_similarity`` with the item.

1. Windows.  A text's shingles are looked up in the items' shingles.  A window
   can only reach the similarity if enough of its shingles are the item's, and
   sliding it right to its first such shingle loses none, so the windows that
   start at a shared shingle and hold enough of them are all that need a
   fingerprint.
2. Fingerprints.  Windows and items get a 64-bit SimHash of their shingles.
   The 64 bits are cut into ``radius + 1`` blocks; two fingerprints within
   ``radius`` bits agree in a block at least, so an equality join on (item,
   block, bits) finds every one of them, and bit_count keeps exactly those.
   The radius decides no result: a fingerprint says nothing certain of the
   similarity (few shingles, or one that is repeated, move many bits), so a
   window beyond it is kept wherever its number of shared shingles, which is
   at least what the multisets share, can still reach the similarity.
3. Verification.  The weighted similarity of all these windows is computed
   from the shingles' words, not their hashes, so that every leak is found.

Words are runs of letters and digits, lower-cased.  Items of fewer than five
words use shingles of all their words; items without words never match.

What is broadcast are the items' shingle hashes, where their number is at most
``max_broadcast_rows``; with more, the same join shuffles.

Rows: null texts have no words; repeated rows and repeated or null ids are told
apart by a row number given when the input is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.llm.common import documents, shielded, write_table
from transitlake.sources.tables import read_table

# Arrays are exploded with the outer form throughout: for the inner one Spark
# infers a size filter and pushes it down with the whole array expression in
# it, which then splits the text once for each of its words.
WIDTH = 5
SPLIT = "[^\\p{L}\\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def shingles(words: Column, width: Column | int, make) -> Column:
    """``make`` of every run of ``width`` words, in order."""
    last = F.size(words) - width + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                         lambda i: make(F.slice(words, i, width)))).otherwise(F.array())


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def simhash(hashes: Column) -> Column:
    """Bitwise majority of an array of longs: counts two bits at a time in the
    halves of 32 accumulators."""
    halves = F.lit(0x0000000100000001)
    zeros = F.array_repeat(F.lit(0).cast("long"), 32)

    def add(acc: Column, h: Column) -> Column:
        return F.transform(acc, lambda x, k: x + F.call_function("shiftrightunsigned", h, k).bitwiseAND(halves))

    def majority(counts: Column, n: Column) -> Column:
        def of(lane: Column, k: Column) -> Column:
            one = lambda count, shift: F.when(2 * count > n, F.call_function(
                "shiftleft", F.lit(1).cast("long"), shift)).otherwise(F.lit(0).cast("long"))
            return one(lane.bitwiseAND(F.lit(0xFFFFFFFF)), k).bitwiseOR(one(F.shiftrightunsigned(lane, 32), k + 32))
        return F.aggregate(F.transform(counts, of), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return _let(hashes, lambda hs: _let(F.aggregate(hs, zeros, add), lambda counts: majority(counts, F.size(hs))))


def _blocks(fp: Column, radius: int) -> Column:
    """(block, bits) of each of radius + 1 blocks."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"),
                              F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("bits"))
                     for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])


def item_table(items: DataFrame, item_id: str, text_col: str, min_similarity: float) -> DataFrame:
    """item (a number), item_id, words, width, hashes, m (shingles), need (least
    shared shingles)."""
    rows = (items.select(F.col(item_id).alias("item_id"), F.monotonically_increasing_id().alias("item"), words_of(F.col(text_col)).alias("words"))
            .where(F.size("words") > 0).withColumn("width", F.least(F.size("words"), F.lit(WIDTH))))
    rows = rows.withColumn("hashes", shingles(F.col("words"), F.col("width"), F.xxhash64)).withColumn("m", F.size("hashes"))
    # the union is no smaller than the item; windows cut off by the end of a text count too
    need = F.ceil(F.col("m") * F.lit(min_similarity) - 1e-9).cast("int")
    return rows.withColumn("need", F.greatest(need, F.lit(1)))


def leaks(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
          min_similarity: float = 0.8, radius: int = 20, max_broadcast_rows: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(marked, found): ``marked`` is ``df`` with ``__row``; ``found`` has
    __row, item_id, n_shared, n_total (their quotient is the similarity),
    start_word (from 0) of the best window, and n_windows that reach it."""
    marked = write_table(df.withColumn("__row", F.monotonically_increasing_id()), "decontamination-input")
    texts = marked.select("__row", F.col(text_col).cast("string").alias("__text"))
    known = write_table(item_table(items, item_id, item_text, min_similarity), "benchmark-items")
    widths = sorted(r.width for r in known.select("width").distinct().collect())  # of 1 to WIDTH

    by_hash = (known.select("item", "width", F.explode_outer("hashes").alias("h")).distinct()
               .groupBy("width", "h").agg(F.collect_list("item").alias("items")))
    if by_hash.count() <= max_broadcast_rows:
        by_hash = F.broadcast(by_hash)
    per_width = F.array(*[F.struct(F.lit(w).alias("width"), shingles(F.col("words"), w, F.xxhash64).alias("hashes"))
                          for w in widths or [WIDTH]])
    shared = (texts.select("__row", words_of(F.col("__text")).alias("words"))
              .select("__row", F.explode_outer(per_width).alias("x"))
              .select("__row", "x.width", F.posexplode_outer("x.hashes").alias("pos", "h"))
              .join(by_hash, ["width", "h"])
              .select("__row", "pos", F.explode_outer("items").alias("item")))
    sizes = known.select("item", "width", "m", "need")
    starts = (shared.groupBy("__row", "item").agg(F.sort_array(F.collect_list("pos")).alias("at"))
              .join(sizes, "item").where(F.size("at") >= F.col("need"))
              .withColumn("starts", F.expr("transform(filter(sequence(0, size(at) - need), "
                                           "j -> at[j + need - 1] < at[j] + m), j -> named_struct('start', at[j], "
                                           "'hits', size(filter(slice(at, j + 1, m), p -> p < at[j] + m))))"))
              .where(F.size("starts") > 0).select("__row", "item", "width", "m", "starts"))
    starts = write_table(starts, "leak-windows")

    windows = (texts.join(starts, "__row").select("__row", "item", "width", "m", "starts", words_of(F.col("__text")).alias("words"))
               .select("__row", "item", "width", F.expr(
                   "transform(starts, s -> named_struct('start', s.start, 'hits', s.hits, "
                   "'window', slice(words, s.start + 1, m + width - 1)))").alias("w"), "m")
               .select("__row", "item", "width", "m", F.explode_outer("w").alias("w")).select("__row", "item", "width", "m", "w.*"))
    total = F.col("m") + F.size("window") - F.col("width") + 1  # of the window's and the item's shingles
    windows = windows.withColumn("reaches", F.col("hits") * F.lit(1 + min_similarity) >= total * F.lit(min_similarity) - 1e-6).drop("m", "hits")
    windows = write_table(windows.withColumn("fp", simhash(shingles(F.col("window"), F.col("width"), F.xxhash64))), "leak-fingerprints")

    index = known.select("item", simhash(F.col("hashes")).alias("item_fp"), "width").withColumn(
        "b", F.explode_outer(_blocks(F.col("item_fp"), radius))).select("item", "item_fp", "b.*")
    near = (windows.select("__row", "item", "start", "fp", F.explode_outer(_blocks(F.col("fp"), radius)).alias("b"))
            .select("__row", "item", "start", "fp", "b.*").join(index, ["item", "block", "bits"])
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
            .select("__row", "item", "start"))
    checked = near.union(windows.where("reaches").select("__row", "item", "start")).distinct()

    text_of = lambda words: F.array_join(words, " ")
    counted = (windows.join(checked, ["__row", "item", "start"])
               .select("__row", "item", "start", F.explode_outer(shingles(F.col("window"), F.col("width"), text_of)).alias("s"))
               .groupBy("__row", "item", "start", "s").agg(F.count(F.lit(1)).alias("n")))
    item_counts = (known.select("item", F.explode_outer(shingles(F.col("words"), F.col("width"), text_of)).alias("s"))
                   .groupBy("item", "s").agg(F.count(F.lit(1)).alias("c")))
    verified = (counted.join(item_counts, ["item", "s"], "left")
                .groupBy("__row", "item", "start")
                .agg(F.sum(F.least("n", F.coalesce("c", F.lit(0)))).alias("n_shared"), F.sum("n").alias("n_window"))
                .join(sizes.select("item", "m"), "item")
                .withColumn("n_total", F.col("n_window") + F.col("m") - F.col("n_shared"))
                .where(F.col("n_shared") >= F.lit(min_similarity) * F.col("n_total") - 1e-9))
    best = F.struct((F.col("n_shared") / F.col("n_total")).alias("sim"), (-F.col("start")).alias("back"), "n_shared", "n_total")
    found = (verified.groupBy("__row", "item").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("n_windows"))
             .join(known.select("item", "item_id"), "item").select("__row", "item_id", "best.n_shared", "best.n_total",
                     (-F.col("best.back")).cast("long").alias("start_word"), "n_windows"))
    return marked, found


def clean(df: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``df``'s rows that no benchmark item leaks into."""
    own, now, restore = shielded(df)
    marked, found = leaks(own, items, now[text_col], **options)
    bad = write_table(found.select("__row").distinct(), "leaks")
    return restore(marked.join(bad, "__row", "left_anti").select(*own.columns))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, found = leaks(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return marked.select("__row", "doc_id").join(found, "__row").drop("__row")


_SQL = """
WITH it AS (SELECT item_id, ws FROM (
       SELECT item_id, array_agg(w ORDER BY i) AS ws FROM (
         SELECT item_id, w, i FROM (SELECT item_id, string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') AS a FROM benchmark),
           unnest(a) WITH ORDINALITY AS u(w, i)) WHERE w <> '' GROUP BY item_id)),
items AS (SELECT item_id, ws, least(len(ws), 5) AS k, len(ws) - least(len(ws), 5) + 1 AS m FROM it),
ishing AS (SELECT item_id, k, m, array_to_string(ws[j:j + k - 1], ' ') AS s
           FROM (SELECT *, unnest(range(1, m + 1)) AS j FROM items)),
icount AS (SELECT item_id, k, m, s, count(*) AS c FROM ishing GROUP BY ALL),
dw AS (SELECT doc_id, array_agg(w ORDER BY i) AS ws FROM (
         SELECT doc_id, w, i FROM (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') AS a FROM documents),
           unnest(a) WITH ORDINALITY AS u(w, i)) WHERE w <> '' GROUP BY doc_id),
widths AS (SELECT DISTINCT k FROM items),
dshing AS (SELECT doc_id, k, j - 1 AS pos, array_to_string(ws[j:j + k - 1], ' ') AS s
           FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM dw, widths WHERE len(ws) >= k)),
starts AS (SELECT DISTINCT doc_id, item_id, k, m, pos AS start FROM dshing JOIN icount USING (k, s)),
wcount AS (SELECT st.doc_id, st.item_id, st.m, st.start, d.s, count(*) AS n
           FROM starts st JOIN dshing d ON d.doc_id = st.doc_id AND d.k = st.k AND d.pos >= st.start AND d.pos < st.start + st.m
           GROUP BY ALL),
sims AS (SELECT w.doc_id, w.item_id, w.start, CAST(sum(least(n, coalesce(c, 0))) AS BIGINT) AS n_shared,
                CAST(sum(n) + any_value(w.m) - sum(least(n, coalesce(c, 0))) AS BIGINT) AS n_total
         FROM wcount w LEFT JOIN icount i ON i.item_id = w.item_id AND i.s = w.s GROUP BY w.doc_id, w.item_id, w.start),
ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_shared / n_total DESC, start) AS r,
              count(*) OVER (PARTITION BY doc_id, item_id) AS n_windows
       FROM sims WHERE n_shared >= 0.8 * n_total - 1e-9)
SELECT doc_id, item_id, n_shared, n_total, CAST(start AS BIGINT) AS start_word, n_windows FROM ok WHERE r = 1
"""

QUERIES = {"op9_decontamination": op9_decontamination}
ORACLE = {"op9_decontamination": _SQL}
