"""Operator 2: exact substring dedup with suffix arrays built by linear grouping.

Every byte covered by a ``length``-byte string that also starts earlier (smaller
id, or earlier in the same text) is removed.

1. Anchors.  In each window of ``length`` bytes the k-gram with the smallest
   hash is the window's anchor (winnowing), so equal windows have equal anchors
   at equal offsets, and an anchor owns a run of consecutive windows.  The
   bytes of that run are the anchor's context.
2. Pre-aggregation.  Anchors are dealt and sorted by (k-gram, context, place)
   and read as a stream.  A k-gram that occurs once owns no repeated window.
   Of equal contexts all but the first are later copies of all their windows;
   only the first goes on, and only if its k-gram has other contexts.
3. Suffix arrays.  The distinct contexts of a k-gram, less the bytes at their
   ends that no other one shares, packed with those of other k-grams, get a
   suffix array by linear grouping (``gsaca``); windows
   with ``length`` equal bytes are neighbours in it, and all but the earliest
   of such a class are later copies.  A k-gram with more than ``max_contexts``
   distinct contexts is split by window instead: its windows are grouped by
   their bytes, so no pack holds an unbounded group.
4. The union of the later copies is cut out of each text.

k-grams and contexts are compared by 64-bit hashes of their bytes (a context
only with those of its own k-gram); the strings that suffix arrays or window
groups compare are compared byte by byte.

Rows: null and empty texts have no bytes; repeated rows and repeated or null
ids are ordered by a row number given when the input is written to the shared
folder (nulls first); very long texts are one row each in every step.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.llm.common import bounded_batches, documents, write_table
from transitlake.llm.gsaca import suffix_array

LENGTH, GRAM = 100, 32
PIECE = 1 << 21  # bytes hashed together
PACK = 1 << 16   # bytes of contexts in one suffix array, more where one k-gram has more
MUL = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
ANCHOR = "h long, c long, id long, __row long, lo int, span int"  # span: windows, and the anchor's offset above bit 16


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position on; k is a power of two."""
    h, power, size = BYTES[data], int(MUL), 1
    while size < k:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power % 2**64, size * 2
    return _scatter(h)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:len(x)] = x
    rows = padded.reshape(-1, w)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(rows, axis=1).ravel()
    n = len(x) - w + 1
    return np.minimum(after[:n], before[w - 1:w - 1 + n])


def anchors(texts: list[bytes], length: int, k: int):
    """(text, k-gram hash, context hash, first window, span) of every anchor."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    per_text = np.maximum(sizes - length + 1, 0)
    if not per_text.sum():
        return None
    h = gram_hashes(data, k)
    # smallest hash, leftmost among equals; its place rides in the low half
    low = np.uint64(0xFFFFFFFF)
    at = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - k + 1) & low
    text = np.repeat(np.arange(len(texts)), per_text)
    window = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + starts[text]
    place = at[window].astype(np.int64)
    first = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    n = np.diff(np.append(first, len(place)))
    place, lo, owner = place[first], window[first], text[first]
    last = lo + n + length - 1 - k  # the context's last k-gram
    c = (n * 1021 + (place - lo)).astype(np.uint64)
    for step in range(0, 2 * length - k, k):
        c = _scatter(c * MUL + h[np.minimum(lo + step, last)])
    return owner, h[place].view(np.int64), c.view(np.int64), lo - starts[owner], n | (place - lo) << 16


def _pieces(batches, length: int):
    """Rows of a batch in pieces of about PIECE bytes."""
    for batch in batches:
        ids, rows, texts = (batch[c] for c in ("id", "__row", "__text"))
        held, size, begin = [], 0, 0
        for i in range(batch.num_rows):
            t = (texts[i].as_py() or "").encode()
            held.append(t)
            size += len(t)
            if size >= PIECE or i == batch.num_rows - 1:
                yield ids.slice(begin, i + 1 - begin), rows.slice(begin, i + 1 - begin), held
                held, size, begin = [], 0, i + 1


def anchor_table(texts: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches):
        for ids, rows, data in _pieces(batches, length):
            found = anchors(data, length, k)
            if found is not None:
                owner, h, c, lo, span = found
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(c), ids.take(take), rows.take(take), pa.array(lo.astype(np.int32)),
                     pa.array(span.astype(np.int32))], names=[x.split()[0] for x in ANCHOR.split(", ")])

    return texts.mapInArrow(run, ANCHOR)


def _split_copies(batches):
    """Stream of anchors sorted by (h, c, place): marks later copies of a
    context (first false), and the first ones of k-grams with several."""
    state_h = state_c = None
    seen, pending = 0, None  # contexts of state_h so far; its only one, not yet passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        h, c = batch["h"].to_numpy(), batch["c"].to_numpy()
        new_h, new_c = np.ones(len(h), bool), np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
        if state_h is not None and h[0] == state_h:
            new_h[0], new_c[0] = False, c[0] != state_c
        run = np.cumsum(new_h)  # 0: goes on from the batch before
        contexts = np.bincount(run, weights=new_c, minlength=run[-1] + 1).astype(np.int64)
        contexts[0] += seen
        if pending is not None:
            if contexts[0] > 1:
                yield pending
                pending = None
            elif run[-1] > 0:
                pending = None
        many = contexts[run] > 1
        open_run = run == run[-1]  # may go on in the next batch
        out = pa.array(np.where(new_c, many, True))
        marked = batch.append_column("first", pa.array(new_c))
        if (hold := np.flatnonzero(new_c & open_run & ~many)).size:
            pending = marked.slice(int(hold[0]), 1)
        yield marked.filter(out)
        state_h, state_c, seen = h[-1], c[-1], int(contexts[-1])


def _later_windows(group: list[tuple], length: int) -> list[tuple]:
    """``group``: (id rank, __row, lo, n, bytes) of distinct contexts.  Returns
    (__row, start, n) of runs of windows that have an earlier equal."""
    text = b"\xff".join(g[4] for g in group)
    data = np.frombuffer(text, np.uint8)
    sizes = np.array([len(g[4]) + 1 for g in group])
    begin = np.cumsum(sizes) - sizes
    n = np.array([g[3] for g in group])
    owner = np.full(len(text) + 1, -1)
    for g, (b, m) in enumerate(zip(begin.tolist(), n.tolist())):
        owner[b:b + m] = g
    order = np.array(suffix_array(text), np.int64)
    order = order[owner[order] >= 0]
    rows = np.lib.stride_tricks.sliding_window_view(data, length)
    equal = np.empty(len(order), bool)
    equal[:1] = False
    for s in range(1, len(order), 4096):  # neighbours of the suffix array with length equal bytes
        e = min(s + 4096, len(order))
        equal[s:e] = (rows[order[s:e]] == rows[order[s - 1:e - 1]]).all(axis=1)
    starts = np.flatnonzero(~equal)
    g = owner[order]
    start = np.array([x[2] for x in group])[g] + order - begin[g]
    texts = {key: r for r, key in enumerate(sorted({(x[0], x[1]) for x in group}))}
    rank = np.array([texts[x[0], x[1]] for x in group], np.int64)[g] << 32 | start
    first = np.minimum.reduceat(rank, starts)
    late = rank > np.repeat(first, np.diff(np.append(starts, len(rank))))
    where = np.sort(order[late])
    if not where.size:
        return []
    cut = np.flatnonzero(np.diff(where, prepend=-2) != 1)
    length_of = np.diff(np.append(cut, len(where)))
    out = []
    for w, m in zip(where[cut].tolist(), length_of.tolist()):
        x = group[owner[w]]
        out.append((x[1], int(x[2] + w - begin[owner[w]]), m))
    return out


def _interval_batch(found: list[tuple]) -> pa.RecordBatch:
    rows, lo, n = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(lo, pa.int32()), pa.array(n, pa.int32())],
                                      names=["__row", "lo", "n"])


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    m = min(len(a), len(b))
    return m - ((int.from_bytes(a[:m]) ^ int.from_bytes(b[:m])).bit_length() + 7) // 8


def _longest(parts: list[bytes]) -> list[int]:
    """Per string its longest common prefix with any other of them."""
    best = [0] * len(parts)
    order = sorted(range(len(parts)), key=parts.__getitem__)
    for x, y in zip(order, order[1:]):
        m = _common(parts[x], parts[y])
        best[x], best[y] = max(best[x], m), max(best[y], m)
    return best


def _trimmed(group: list[tuple], length: int) -> list[tuple]:
    """``group``: (place, __row, lo, n, bytes, anchor offset) of one k-gram's
    contexts.  Windows that reach further left or right of the anchor than any
    other context agrees have no equal, so those bytes need no suffix array."""
    if len(group) < 2:
        return []
    right = _longest([g[4][g[5]:] for g in group])
    left = _longest([g[4][:g[5]][::-1] for g in group])
    return [(place, row, lo + at - a, a + b - length + 1, data[at - a:at + b])
            for (place, row, lo, _, data, at), a, b in zip(group, left, right) if a + b >= length]


def _suffix_array_stream(length: int):
    names = ("h", "id", "__row", "lo", "n", "at", "bytes")

    def run(batches):
        pack, size, group, last = [], 0, [], None
        for batch in batches:
            for h, i, row, lo, n, at, data in zip(*(batch[c].to_pylist() for c in names)):
                if h != last:
                    ready = _trimmed(group, length)
                    pack += ready
                    size += sum(len(x[4]) for x in ready)
                    group, last = [], h
                    if size >= PACK:
                        yield _interval_batch(_later_windows(pack, length))
                        pack, size = [], 0
                group.append((_order(i), row, lo, n, data, at))
        pack += _trimmed(group, length)
        if pack:
            yield _interval_batch(_later_windows(pack, length))

    return run


def _order(i) -> tuple:
    return (i is not None, i or 0)


def _grouped(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("__row").agg(F.collect_list(F.struct("lo", "n")).alias("__cuts"))


def later_copies(texts: DataFrame, length: int = LENGTH, k: int = GRAM, max_contexts: int = 20_000) -> DataFrame:
    """``texts``: id, __row, __text.  Returns __row, lo, n: runs of n windows
    from byte lo on that also start earlier."""
    place = ["id", "__row", "lo"]
    n_parts = texts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    split = write_table(anchor_table(texts, length, k).repartition(int(n_parts), "h").sortWithinPartitions("h", "c", *place)
                        .mapInArrow(_split_copies, f"{ANCHOR}, first boolean"), "substring-copies")
    windows_of = F.col("span").bitwiseAND(F.lit(0xFFFF)).alias("n")
    copies = split.where("not first").select("__row", "lo", windows_of)

    firsts = split.where("first").select("h", "__row", "lo", windows_of, F.shiftright("span", 16).alias("at"))
    heavy = firsts.groupBy("h").count().where(F.col("count") > max_contexts).select("h", F.lit(True).alias("heavy"))
    wanted = firsts.join(heavy, "h", "left").groupBy("__row").agg(
        F.collect_list(F.struct("h", "lo", "n", "at", F.coalesce("heavy", F.lit(False)).alias("heavy"))).alias("x"))
    fetch = texts.join(wanted, "__row")
    schema = "h long, id long, __row long, lo int, n int, at int, heavy boolean, bytes binary"

    def contexts(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                doc, row, data = batch["id"][i].as_py(), batch["__row"][i].as_py(), batch["__text"][i].as_py().encode()
                out += [(x["h"], doc, row, x["lo"], x["n"], x["at"], x["heavy"], data[x["lo"]:x["lo"] + x["n"] + length - 1])
                        for x in batch["x"][i].as_py()]
                if len(out) > 20_000:
                    yield _rows(out, schema)
                    out = []
            if out:
                yield _rows(out, schema)

    context = fetch.mapInArrow(contexts, schema)
    context = write_table(context, "substring-contexts")
    packed = (context.where("not heavy").repartition(int(n_parts), "h").sortWithinPartitions("h", "__row", "lo")
              .mapInArrow(_suffix_array_stream(length), "__row long, lo int, n int"))

    windows = (context.where("heavy").select("id", "__row", "lo", "bytes", F.explode_outer(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
               .select(F.expr(f"substring(bytes, j + 1, {length})").alias("window"),
                       F.struct("id", "__row", (F.col("lo") + F.col("j")).alias("lo")).alias("place")))
    earliest = windows.groupBy("window").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1")
    split_up = (windows.join(earliest, "window").where(~F.col("place").eqNullSafe(F.col("least")))
                .select("place.__row", "place.lo", F.lit(1).alias("n")))
    return copies.union(packed).union(split_up)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(col, kinds[kind]) for col, (_, kind) in zip(zip(*rows), fields)],
                                      names=[name for name, _ in fields])


def cut_out(data: bytes, lo: np.ndarray, n: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal removed runs)."""
    edge = np.bincount(lo, minlength=len(data) + 1) - np.bincount(lo + n + length - 1, minlength=len(data) + 1)
    gone = np.cumsum(edge[:-1]) > 0
    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return left, int(gone.sum()), int(np.count_nonzero(np.diff(gone, prepend=False) & gone))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = GRAM,
          max_contexts: int = 20_000) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    bounded_batches(df.sparkSession)
    marked = write_table(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("__text"))
                         .withColumn("__row", F.monotonically_increasing_id()), "substring-input")
    cuts = _grouped(later_copies(marked, length, k, max_contexts))
    joined = marked.join(cuts, "__row", "left").select("id", "__text", "__cuts")

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                out = []
                cuts = part["__cuts"].flatten()
                lo, n = (cuts.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                ends = np.cumsum(pc.fill_null(part["__cuts"].value_lengths(), 0).to_numpy())
                for text, b, e in zip(part["__text"].to_pylist(), [0, *ends], ends):
                    data = (text or "").encode()
                    out.append((len(data), *(cut_out(data, lo[b:e], n[b:e], length) if e > b else (data, 0, 0))))
                size, left, removed, spans = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [part["id"], *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(left, pa.binary())],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return rows.withColumnRenamed("id", id_col)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLE: dict[str, str] = {}
