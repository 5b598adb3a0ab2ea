"""Operator 10: SimHash near-duplicates by a binary trie self-join.

A text's 64-bit fingerprint is the bitwise majority of the XXH64 (seed 42) of
its word shingles.  Equal fingerprints are collapsed first; the distinct ones
are joined with themselves on binary tries.  A pair of trie nodes is traversed
together, one bit a step: (u, v) goes to (u0, v0), (u1, v1) and, with one more
differing bit, to (u0, v1) and (u1, v0); it is pruned as soon as its differing
bits exceed the budget at that depth.

To keep the upper levels from exploding the bits are read in ``max_bits + 1``
blocks, once from each block on (cyclically).  If two fingerprints differ in at
most ``max_bits`` bits, then from some block on the first l blocks hold at most
l - 1 differing bits, for every l (cycle lemma).  So each of the tries prunes
with the budget 0, 1, 2, ... by block, none loses a pair that all the others
lose, and the first block is an equality: the key by which sub-tries are dealt
to tasks.  Units of more than ``split_rows`` distinct fingerprints are descended
``SPLIT_BITS`` levels further in Spark (their node pairs become units of their
own), again and again until none is larger, so no task gets a large one whole.

Within a task links are reduced to a spanning forest, and node pairs that lie
wholly in one component are skipped, so a large group of near copies costs
about its size and not its square.  Components are then joined by star
contraction in Spark.

Rows: a null or empty text has fingerprint zero and links like any other;
repeated rows are linked by their equal fingerprints; a null id never is a
component id unless its component has no other; ``representatives`` carries
extra columns whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.llm.common import documents, map_texts, shielded, write_table
from transitlake.llm.components import connected_components

SPLIT_BITS = 8
BATCH_ROWS = 1 << 17  # rows of whole units taken on together
CHUNK = 1 << 16       # node pairs expanded together
LEAF = 16             # pairs of so few fingerprints are compared at once
ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, width: int) -> list[int]:
    words = text.encode().lower().split()  # bytes: lowers A-Z, splits at \x20, \x09-\x0D
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return [h(joined[s:e], 42) for s, e in zip(starts, ends[width - 1:].tolist() or [len(joined)])]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """Per list the bits that over half of its hashes have set.  Counts eight
    bits at a time in the bytes of a word, over at most 255 hashes."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not full.size:
        return out
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, sizes.sum())
    begin = np.cumsum(sizes) - sizes
    cuts, owner = [], []
    for i in full:
        parts = range(int(begin[i]), int(begin[i] + sizes[i]), 255)
        cuts += parts
        owner += [i] * len(parts)
    owner = np.array(owner)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    for k in range(8):
        sums = np.add.reduceat((flat >> np.uint64(k)) & ONES, cuts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            on = 2 * counts[:, byte] > sizes[full]
            out[full[on]] |= np.uint64(1 << (8 * byte + k))
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                 carry: list[str] | None = None) -> DataFrame:
    """id, ``carry``, __fp (the 64 bits as a long)."""

    def run(texts):
        return [pa.array(majority([shingle_hashes(t, width) for t in texts]).view(np.int64))]

    return map_texts(df, id_col, text_col, "__fp long", run, carry)


def _blocks(n: int) -> list[int]:
    """First bit of each of n blocks, and 64."""
    return [64 * i // n for i in range(n)] + [64]


def _budgets(rotation: int, edges: list[int]) -> list[int]:
    """Differing bits allowed after d bits read from block ``rotation`` on."""
    n = len(edges) - 1
    order = [(rotation + i) % n for i in range(n)]
    return [0, *(rank for rank, b in enumerate(order) for _ in range(edges[b], edges[b + 1]))]


class _Forest:
    """Components over the rows of a task: label is the smallest row."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            if (open_ := x != y).any():
                lo, hi = np.minimum(x, y)[open_], np.maximum(x, y)[open_]
                np.minimum.at(label, hi, lo)
                while (label[label] != label).any():
                    label[:] = label[label]
            else:
                return


def link_units(fp: np.ndarray, pairs: np.ndarray, depths: np.ndarray, budgets: np.ndarray,
               max_bits: int) -> np.ndarray:
    """Traverse node pairs over ``fp`` (bits in reading order, sorted within
    each node).  ``pairs``: columns a_lo, a_hi, b_lo, b_hi, differing bits,
    row of ``budgets``.  Returns each row's component label."""
    forest = _Forest(len(fp))
    stack = [(int(d), pairs[depths == d]) for d in np.unique(depths)]
    while stack:
        depth, now = stack.pop()
        if len(now) > CHUNK:
            stack.append((depth, now[CHUNK:]))
            now = now[:CHUNK]
        # node pairs inside one component have nothing left to link
        change = np.cumsum(np.diff(forest.label, prepend=-1) != 0)
        same = lambda lo, hi: change[lo] == change[hi - 1]
        done = same(now[:, 0], now[:, 1]) & same(now[:, 2], now[:, 3])
        done &= forest.label[now[:, 0]] == forest.label[now[:, 2]]
        now = now[~done]
        n_a, n_b = now[:, 1] - now[:, 0], now[:, 3] - now[:, 2]
        leaf = (n_a * n_b <= LEAF) | (depth == 64)
        small, now = now[leaf], now[~leaf]
        if len(small):
            a, b = _rows_of(small)
            near = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
            forest.link(a[near], b[near])
        if not len(now):
            continue
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)])
        a_lo, a_hi, b_lo, b_hi, diff, row = now.T
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        itself = a_lo == b_lo
        children = [(a_lo, a_mid, b_lo, b_mid, diff, row), (a_mid, a_hi, b_mid, b_hi, diff, row),
                    (a_lo, a_mid, b_mid, b_hi, diff + 1, row),
                    tuple(c[~itself] for c in (a_mid, a_hi, b_lo, b_mid, diff + 1, row))]
        nxt = np.concatenate([np.stack(c, 1) for c in children])
        fits = (nxt[:, 1] > nxt[:, 0]) & (nxt[:, 3] > nxt[:, 2]) & (nxt[:, 4] <= budgets[nxt[:, 5], depth + 1])
        fits &= (nxt[:, 0] != nxt[:, 2]) | (nxt[:, 1] - nxt[:, 0] > 1)
        stack.append((depth + 1, nxt[fits]))
    return forest.label


def _rows_of(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All row pairs of small node pairs."""
    n_b = pairs[:, 3] - pairs[:, 2]
    count = (pairs[:, 1] - pairs[:, 0]) * n_b
    owner = np.repeat(np.arange(len(pairs)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return pairs[owner, 0] + k // n_b[owner], pairs[owner, 2] + k % n_b[owner]


def _descend(rows: DataFrame, budgets: np.ndarray) -> DataFrame:
    """The rows of units (pairs of nodes u, v at ``depth``), in the units
    SPLIT_BITS further down: pairs of nodes that both have rows and whose
    differing bits keep within the budget there.  The pairs are made from the
    nodes, at most 2 * 2^SPLIT_BITS a unit, so rows follow only into pairs."""
    below = F.col("depth") + SPLIT_BITS
    rows = rows.select("turn", below.alias("depth"), "u", "v", "bits",
                       F.call_function("shiftrightunsigned", F.col("bits"), 64 - below).alias("node"))
    place = ["turn", "depth", "u", "v", "node"]
    nodes = write_table(rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).select(*place), "trie-nodes")
    allowed = F.get(F.get(F.array(*[F.array(*map(F.lit, row.tolist())) for row in budgets]), F.col("turn")), F.col("depth"))
    apart = F.col("u").bitwiseXOR(F.col("v"))
    masks = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << SPLIT_BITS) - 1).cast("long")),
                     lambda m: F.bit_count(m) <= F.col("left"))
    other = F.shiftleft(apart, SPLIT_BITS).bitwiseXOR(F.col("mask")).bitwiseXOR(F.col("node"))
    pairs = (nodes.withColumn("left", allowed - F.bit_count(apart)).withColumn("mask", F.explode(masks)).withColumn("other", other)
             .join(nodes.withColumnRenamed("node", "other"), ["turn", "depth", "u", "v", "other"], "left_semi"))
    pairs = write_table(pairs.select(*place, F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")), "trie-pairs")
    return rows.join(pairs, place).select("turn", "depth", F.col("a").alias("u"), F.col("b").alias("v"), "bits")


def links(fps: DataFrame, max_bits: int = 4, split_rows: int = 200_000) -> DataFrame:
    """``fps``: one row per distinct long ``fp``.  Returns a, b: a forest of
    links that connects exactly what lies within ``max_bits`` bits."""
    edges = _blocks(max_bits + 1)
    first = [edges[r + 1] - edges[r] for r in range(max_bits + 1)]
    turned = lambda r: F.shiftleft("fp", edges[r]).bitwiseOR(
        F.shiftrightunsigned("fp", 64 - edges[r])) if edges[r] else F.col("fp")
    rows = fps.select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("turn"), F.lit(first[r]).alias("depth"), F.shiftrightunsigned(turned(r), 64 - first[r]).alias("u"),
                 turned(r).alias("bits")) for r in range(max_bits + 1)])).alias("x")).select("x.*")
    rows = rows.select("turn", "depth", "u", F.col("u").alias("v"), "bits")
    unit = ["turn", "depth", "u", "v"]
    budgets = np.array([_budgets(r, edges) for r in range(max_bits + 1)])
    light = []
    for _ in range(max(first) + SPLIT_BITS, 64, SPLIT_BITS):  # deeper units have few fingerprints
        heavy = write_table(rows.groupBy(*unit).count().where(F.col("count") > split_rows).select(*unit), "heavy-units")
        if heavy.isEmpty():
            break
        light.append(rows.join(heavy, unit, "left_anti"))
        rows = write_table(_descend(rows.join(heavy, unit, "left_semi"), budgets), "split-units")
    for done in light:
        rows = rows.union(done)

    def take(table: pa.Table) -> pa.RecordBatch:
        turn, depth, u, v = (table[c].to_numpy().astype(np.int64) for c in unit)
        bits = table["bits"].to_numpy().view(np.uint64)
        new = np.ones(len(bits), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in (turn, depth, u, v)], axis=0)
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(bits))
        # in a unit of two nodes, the rows of v follow those of u
        of_v = np.concatenate([[0], np.cumsum((u != v) & ((bits >> (64 - depth).astype(np.uint64)).astype(np.int64) == v))])
        mid = hi - (of_v[hi] - of_v[lo])
        two = u[lo] != v[lo]
        start = np.stack([lo, np.where(two, mid, hi), np.where(two, mid, lo), hi, np.bitwise_count(u[lo] ^ v[lo]), turn[lo]], 1)
        keep = np.where(two, (mid > lo) & (hi > mid), hi - lo > 1)
        label = link_units(bits, start[keep].astype(np.int64), depth[lo][keep], budgets, max_bits)
        at = np.flatnonzero(label != np.arange(len(bits)))
        back = np.array(edges[:-1])[turn[at]].astype(np.uint64)
        undo = lambda x: np.where(back > 0, (x >> back) | (x << (np.uint64(64) - np.maximum(back, np.uint64(1)))), x).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(undo(bits[at])), pa.array(undo(bits[label[at]]))], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= BATCH_ROWS:
                table = pa.Table.from_batches(held)
                key = [table[c].to_numpy() for c in unit]
                last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
                cut = int(last[-1]) + 1 if last.size else 0  # rows before the last unit, which may go on
                if cut:
                    yield take(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    n = table.num_rows - cut
        if n:
            yield take(pa.Table.from_batches(held))

    return (rows.repartition(*unit).sortWithinPartitions(*unit, "bits")
            .mapInArrow(run, "a long, b long"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                    max_bits: int = 4, carry: list[str] | None = None) -> DataFrame:
    """id, ``carry``, __fingerprint (16 hex digits), __component (smallest id
    that links reach), __first (true for one row of each component)."""
    marked = write_table(fingerprints(df, id_col, text_col, width, carry)
                         .withColumn("__row", F.monotonically_increasing_id()), "fingerprints")
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    fps = write_table(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min(rank).alias("first")), "distinct-fingerprints")
    roots = connected_components(links(fps.select("fp"), max_bits))
    members = roots.union(roots.select("root", "root").distinct())
    found = members.join(fps, F.col("node") == F.col("fp")).select("fp", "root", "first")
    least = found.groupBy("root").agg(F.min("first").alias("least"))
    least = found.join(least, "root").select(F.col("fp").alias("m"), "least")
    # written, so that the last join deals both sides anew and can split a hot fingerprint
    firsts = write_table(fps.join(least, F.col("fp") == F.col("m"), "left").select(
        F.col("fp").alias("__fp"), F.coalesce("least", "first").alias("__least")), "firsts")
    return marked.join(firsts, "__fp").select(
        id_col, *(carry or []), F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("__fingerprint"),
        F.col("__least.id").alias("__component"), (F.col("__row") == F.col("__least.row")).alias("__first"))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df``'s rows that stand first (by id) in their component."""
    own, now, restore = shielded(df)
    carry = [c for c in own.columns if c != now[id_col]]
    rows = near_duplicates(own, now[id_col], now[text_col], carry=carry, **options)
    return restore(rows.where("__first").select(*own.columns))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.col("__fingerprint").alias("fingerprint"), F.col("__component").alias("component_id"))


QUERIES = {"op10_simhash": op10_simhash}
ORACLE: dict[str, str] = {}
