"""Operator 11: alignment of two tokenizers by as-of merges.

A is a byte-level BPE (tokenizers), B a BPE with byte fallback (sentencepiece).
Both cover the bytes of space + text without gaps, so per batch
``pandas.merge_asof``, keyed by document, gives each token start the other
side's covering token.  The two directions' union is the overlaps; a token that
starts where its covering token starts follows an end that both sides share,
and these equal ends cut the tokens into groups.  In a group with one token on
one side the overlaps are its links; in any other every A token is linked with
every B token, counted by distinct ids and multiplicity, so a group of a
thousand equal tokens on each side is one row and not a million.

Links are counted over the corpus in blocks of documents: a block is a row that
holds its documents' links as indexes into its own list of distinct id pairs.
Only these lists are shuffled: summed by pair, marked where a pair's count is
its A id's highest, and joined back to the blocks; nothing is broadcast by
hand, and a pair that is in every document is one row per block.

Texts are cut at spaces and newlines between visible characters, where neither
tokenizer joins what stands on both sides, and each distinct chunk is encoded
once per task (a bounded table; encoding a chunk again changes no result).  Texts
longer than a slice are aligned in segments between such cuts.

Rows: texts that are null, empty or not given back byte for byte by both sides
(a text with U+2581, which B reads as a space) have no tokens: zeros and ''.
Repeated rows and ids each give a row and count as documents of their own;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transitlake.llm.common import SLICE_BYTES, bounded_batches, documents, text_slices, write_table
from transitlake.llm.sentencepiece_codec import MARK, ChunkCodec, model_path

CUT = re.compile(r"([ \n])(?<=[!-~\w][ \n])(?=[!-~\w])")
LARGE_GROUP = 4096  # links from which a group is counted by distinct ids at once
GROUP_BYTES = 1 << 20  # of written blocks: a row group each, as the reader holds a whole one decoded
_SIDES: dict = {}


@lru_cache(maxsize=1)
def byte_of_symbol() -> dict[str, int]:
    """The printable symbol of every byte in a byte-level vocabulary: visible
    Latin-1 characters stand for themselves, the rest are numbered on from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Sides:
    """Both tokenizers, their tokens' bytes and the table of known chunks."""

    def __init__(self, byte_file: str, piece_file: str, max_entries: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        symbol = byte_of_symbol()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(symbol[c] for c in t) if all(c in symbol for c in t) else t.encode() for t in names]
        self.b = ChunkCodec(piece_file, 1).sp  # checked: no piece joins what a cut parts; no prefix of its own
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in side], "i8") for side in (self.a_bytes, self.b_bytes))
        number = lambda n, ends: [np.array([f"{i}{e}" for i in range(n)], object) for e in ends]
        self.a_text, self.a_last = number(len(names), ",|")
        self.b_text, self.b_last = number(len(pieces), ",;")
        self.max_entries = max_entries
        self.forget()

    def forget(self) -> None:
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.older_a, self.older_b = self.known_a, self.known_b
        self.unfaithful: set[str] = set()

    def learn(self, chunks: set[str]) -> None:
        """Put all of ``chunks`` into the table.  A full table is set aside and
        what is still asked for moves over, so at most two are held."""
        if len(self.known_a) + len(chunks) > self.max_entries:
            self.older_a, self.older_b, self.known_a, self.known_b = self.known_a, self.known_b, {}, {}
            self.unfaithful &= self.older_a.keys()
        new = []
        for chunk in chunks:
            if chunk not in self.known_a:
                if (ids := self.older_a.get(chunk)) is not None:
                    self.known_a[chunk], self.known_b[chunk] = ids, self.older_b[chunk]
                else:
                    new.append(chunk)
        ids_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        ids_b = self.b.encode([c.replace(" ", MARK) for c in new], num_threads=1)
        data = "".join(new).encode()
        for ids, known, side in ((ids_a, self.known_a, self.a_bytes), (ids_b, self.known_b, self.b_bytes)):
            flat = np.fromiter(chain.from_iterable(ids), "<i4")
            raw, ends = flat.tobytes(), np.cumsum([4 * len(x) for x in ids]).tolist()
            known.update(zip(new, map(raw.__getitem__, map(slice, [0, *ends], ends))))
            if b"".join([side[i] for i in flat.tolist()]) != data:
                self.unfaithful.update(c for c, x in zip(new, ids) if b"".join([side[i] for i in x]) != c.encode())
            else:  # as many bytes in all, but are they cut at the same chunks?
                sizes = np.add.reduceat(np.append(self.sizes(side)[flat], 0), np.array([0, *ends[:-1]]) // 4) if new else []
                self.unfaithful.update(c for c, n in zip(new, sizes) if n != len(c.encode()))

    def sizes(self, side: list[bytes]) -> np.ndarray:
        return self.a_len if side is self.a_bytes else self.b_len

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of each text (space already in front), 32 bits each; a text that
        is not given back whole has none."""
        parts = [chunks(t) if t else [] for t in texts]
        self.learn(set().union(*parts))
        a = [b"".join(map(self.known_a.__getitem__, p)) for p in parts]
        b = [b"".join(map(self.known_b.__getitem__, p)) for p in parts]
        if self.unfaithful:
            for i, p in enumerate(parts):
                if not self.unfaithful.isdisjoint(p) and not self.faithful(texts[i], a[i], b[i]):
                    a[i] = b[i] = b""
        return a, b

    def faithful(self, text: str, a: bytes, b: bytes) -> bool:
        data = text.encode()
        return all(b"".join([side[i] for i in np.frombuffer(ids, "<i4")]) == data
                   for ids, side in ((a, self.a_bytes), (b, self.b_bytes)))


def chunks(text: str) -> list[str]:
    """``text`` cut where neither tokenizer joins; a space begins a chunk, a
    newline is one."""
    parts = CUT.split(text)
    out = parts[:1]
    for i in range(1, len(parts), 2):
        if parts[i] == " ":
            out.append(" " + parts[i + 1])
        else:
            out += (parts[i], parts[i + 1])
    return out


def segments(text: str, size: int = SLICE_BYTES) -> list[str]:
    """A long text in parts of about ``size`` characters between cuts."""
    out, start = [], 0
    while len(text) - start > size and (m := CUT.search(text, start + size)):
        out.append(text[start:m.start()])
        start = m.start()
    return [*out, text[start:]]


def _sides(*key) -> Sides:
    if key not in _SIDES:
        _SIDES[key] = Sides(*key)
    return _SIDES[key]


def covering(tokens: pd.DataFrame, other: pd.DataFrame) -> np.ndarray:
    """Per token start the row of the other side's covering token."""
    right = other.assign(row=np.arange(len(other)))
    return pd.merge_asof(tokens, right, on="start", by="doc")["row"].to_numpy()


def align(sides: Sides, a_raw: list[bytes], b_raw: list[bytes]) -> dict:
    """Per text: tokens, groups, links, overlaps, the groups as text; and the
    links as sorted keys (text, A id, B id) with their number."""
    n = len(a_raw)
    a, b = (np.frombuffer(b"".join(raw), "<i4").astype("i8") for raw in (a_raw, b_raw))
    n_a, n_b = (np.array([len(x) // 4 for x in raw], "i8") for raw in (a_raw, b_raw))
    doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    len_a, len_b = sides.a_len[a], sides.b_len[b]
    start_a, start_b = np.cumsum(len_a) - len_a, np.cumsum(len_b) - len_b
    frame_a, frame_b = (pd.DataFrame({"start": s, "doc": d}) for s, d in ((start_a, doc_a), (start_b, doc_b)))
    over_a, over_b = covering(frame_a, frame_b), covering(frame_b, frame_a)
    new_a, new_b = start_a == start_b[over_a], start_b == start_a[over_b]
    group_a, group_b = np.cumsum(new_a) - 1, np.cumsum(new_b) - 1
    size_a, size_b = np.bincount(group_a), np.bincount(group_b)
    n_groups = np.bincount(doc_a[new_a], minlength=n)
    run = np.concatenate([[0], np.cumsum(size_a * size_b)])
    ends = np.cumsum(n_groups)
    n_links = run[ends] - run[ends - n_groups]

    # links: overlaps of narrow groups, all pairs of the others
    rest = ~new_b
    edge_a, edge_b = np.concatenate([np.arange(len(a)), over_b[rest]]), np.concatenate([over_a, np.flatnonzero(rest)])
    narrow = (size_a == 1) | (size_b == 1)
    pick = narrow[group_a[edge_a]]
    edge_a, edge_b = edge_a[pick], edge_b[pick]
    large = ~narrow & (size_a * size_b > LARGE_GROUP)
    wide = np.flatnonzero((~narrow & ~large)[group_a])
    times = size_b[group_a[wide]]
    wide_a = np.repeat(wide, times)
    first_b = np.cumsum(size_b) - size_b
    wide_b = first_b[group_a[wide_a]] + np.arange(len(wide_a)) - np.repeat(np.cumsum(times) - times, times)
    edge_a, edge_b = np.concatenate([edge_a, wide_a]), np.concatenate([edge_b, wide_b])
    width_a, width_b = len(sides.a_len), len(sides.b_len)
    keys, number = np.unique((doc_a[edge_a] * width_a + a[edge_a]) * width_b + b[edge_b], return_counts=True)
    first_a = np.cumsum(size_a) - size_a
    for g in np.flatnonzero(large):
        of_a, times_a = np.unique(a[first_a[g]:first_a[g] + size_a[g]], return_counts=True)
        of_b, times_b = np.unique(b[first_b[g]:first_b[g] + size_b[g]], return_counts=True)
        more = ((doc_a[first_a[g]] * width_a + of_a)[:, None] * width_b + of_b).ravel()
        keys, number = summed(np.concatenate([keys, more]), np.concatenate([number, np.outer(times_a, times_b).ravel()]))

    # the groups as text: tokens in the order of their groups, A before B
    through_a = np.cumsum(size_a)
    words = np.empty(len(a) + len(b), object)
    last_a, last_b = np.append(new_a[1:], True)[:len(a)], np.append(new_b[1:], True)[:len(b)]
    words[np.arange(len(a)) + first_b[group_a]] = np.where(last_a, sides.a_last[a], sides.a_text[a])
    words[np.arange(len(b)) + through_a[group_b]] = np.where(last_b, sides.b_last[b], sides.b_text[b])
    stops = np.cumsum(n_a + n_b)
    texts = ["".join(words[e - m:e].tolist())[:-1] for e, m in zip(stops, n_a + n_b)]
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "n_overlaps": n_a + n_b - n_groups,
            "texts": texts, "keys": keys, "number": number}


def summed(keys: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their numbers added up."""
    if not len(keys):
        return keys, number
    order = np.argsort(keys, kind="stable")
    keys, number = keys[order], number[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(number, first)


def align_texts(sides: Sides, texts: list[str]) -> dict:
    """``align`` of whole texts; a long one in segments, then added up."""
    if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
        parts = segments(" " + texts[0])
        raw = [sides.encode([p]) for p in parts]
        a, b = (b"".join(x[side][0] for x in raw) for side in (0, 1))
        if not all(x[0][0] for x in raw) and not sides.faithful(" " + texts[0], a, b):
            return align(sides, [b""], [b""])
        done = [align(sides, *x) for x in raw]
        out = {c: sum(d[c] for d in done) for c in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")}
        out["texts"] = [";".join(d["texts"][0] for d in done)]
        out["keys"], out["number"] = summed(*(np.concatenate([d[c] for d in done]) for c in ("keys", "number")))
        return out
    return align(sides, *sides.encode([" " + t if t else "" for t in texts]))


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]
BLOCK = ("block long, {c} array<long>, groups array<string>, sizes array<int>, links array<int>, numbers array<long>, "
         "pairs array<long>, documents array<long>").replace("{c}", " array<long>, ".join(COUNTS))


def blocks(df: DataFrame, byte_file: str, piece_file: str, id_col: str, text_col: str, render: bool,
           block_bytes: int, max_entries: int) -> DataFrame:
    """One row per block: its documents' ids, counts, groups (a digest, or the
    text with ``render``) and links, and its distinct id pairs, each with the
    number of its documents."""
    bounded_batches(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"ids array<{src.schema['id'].dataType.simpleString()}>, {BLOCK}"
    names = [x.split()[0] for x in schema.split(", ")]
    digest = lambda s: s if render or not s else hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        sides = _sides(byte_file, piece_file, max_entries)
        span = len(sides.a_len) * len(sides.b_len)
        task, made = TaskContext.get().partitionId(), 0

        def row(held):
            nonlocal made
            made += 1
            keys, number = (np.concatenate([h[c] for _, h in held]) for c in ("keys", "number"))
            sizes = np.concatenate([np.bincount(h["keys"] // span, minlength=len(h["texts"])) for _, h in held])
            pairs, links, documents = np.unique(keys % span, return_inverse=True, return_counts=True)
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
            return pa.RecordBatch.from_arrays(
                [one(pa.concat_arrays([ids for ids, _ in held]), None), pa.array([(task << 33) + made], pa.int64()),
                 *(one(np.concatenate([h[c] for _, h in held]), pa.int64()) for c in COUNTS),
                 one([digest(t) for _, h in held for t in h["texts"]], pa.string()), one(sizes, pa.int32()),
                 one(links, pa.int32()), one(number, pa.int64()), one(pairs, pa.int64()), one(documents, pa.int64())], names=names)

        held, size = [], 0
        for part, texts in text_slices(batches):
            held.append((part.column(0), align_texts(sides, texts)))
            size += sum(map(len, texts)) + 64 * len(texts)
            if size >= block_bytes:
                yield row(held)
                held, size = [], 0
        if held:
            yield row(held)

    return src.mapInArrow(run, schema)


def pair_counts(made: DataFrame, width_b: int) -> DataFrame:
    """pair, a, b, count (documents that hold the pair linked), best (whether
    no pair of the A id has a higher count)."""
    entry = F.explode(F.arrays_zip("pairs", "documents")).alias("e")
    counts = made.select(entry).groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.documents").alias("count"))
    counts = counts.withColumns({"a": F.expr(f"pair div {width_b}L"), "b": F.col("pair") % width_b})
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def link_sums(made: DataFrame, counts: DataFrame) -> DataFrame:
    """A row per document: id, counts, groups, n_best, count_sum.  A block meets
    its pairs as a group, sorted and streamed: no task lists many blocks' pairs."""
    known = (made.select(F.col("block").alias("of"), F.posexplode("pairs").alias("i", "pair"))
             .join(counts.select("pair", "count", "best"), "pair").select("of", "i", "count", "best"))
    kind = made.schema["ids"].dataType.elementType.simpleString()
    names = ["id", *COUNTS, "n_best", "count_sum", "groups"]
    schema = ", ".join([f"id {kind}", *(f"{c} long" for c in names[1:-1]), "groups string"])

    def run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        place = pairs["i"].to_numpy()
        count, best = np.zeros((2, len(place)), "i8")
        count[place], best[place] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
        made = []
        for k in range(rows.num_rows):
            value = lambda c: rows[c][k].values  # noqa: B023, E731
            sizes, links, number = (value(c).to_numpy().astype("i8") for c in ("sizes", "links", "numbers"))
            ends = np.cumsum(sizes)
            sums = [np.append(0, np.cumsum(number * weight[links])) for weight in (best, count)]
            made.append(pa.Table.from_arrays([value("ids"), *(value(c) for c in COUNTS),
                                              *(pa.array(s[ends] - s[ends - sizes], pa.int64()) for s in sums), value("groups")], names=names))
        return pa.concat_tables(made)

    rows = made.select("ids", "block", *COUNTS, "groups", "sizes", "links", "numbers").groupBy("block")
    return rows.cogroup(known.groupBy("of")).applyInArrow(run, schema)


def alignment(df: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text", render: bool = False,
              block_bytes: int = 8 << 20, max_entries: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(a row per document: id, n_a, n_b, n_groups, n_links, n_overlaps, n_best,
    count_sum, groups), (a row per linked id pair: pair, a, b, count, best).
    ``groups`` is the text ``a1,a2|b1;a3|b2`` with ``render``, else its SHA-256."""
    made = write_table(blocks(df, byte_file, piece_file, id_col, text_col, render, block_bytes, max_entries), "alignment-blocks",
                       group_bytes=GROUP_BYTES)
    width_b = _sides(byte_file, piece_file, max_entries).b.get_piece_size()
    counts = write_table(pair_counts(made, width_b), "alignment-pairs")
    return link_sums(made, counts).withColumnRenamed("id", id_col), counts


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = alignment(documents(spark, sf_dir), model_path("byte_bpe_50k.json"), model_path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"),
                       "n_overlaps")


QUERIES = {"op11_alignment": op11_alignment}
ORACLE: dict[str, str] = {}
