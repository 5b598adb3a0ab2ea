"""Operator 6: secret scan with a token-efficiency test.

Base spans come from three patterns (assignments, access keys, long lower-case
hex runs).  The method adds spans of kind ``random``: runs of at least 16
characters of ``[A-Za-z0-9+/_=-]`` that the tiktoken vocabulary compresses badly
(few characters per token), as text and ordinary names do not.  What a base span
covers is cut out of a run, and each rest of at least 16 characters is a run of
its own.  A run is cut into parts at ``/_=-``; a part is ordinary if it holds no
letter, is a known digest (hex of the common digest lengths, UUIDs), is one token,
or has more characters per token than the limit (``+`` joins such pieces).  A run
of ordinary parts is an identifier.  Any other is random as a whole if it
compresses badly as a whole; else its stretches of parts that are not ordinary
are (short single tokens and numbers within them go along), so that words around
a random string do not hide it.  Spans are code points, end exclusive.

Rows: null reads as empty and gives zero counts and an empty span list;
repeated rows each give a row; whole texts are scanned, in slices of documents,
so that memory does not grow with the table.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from transitlake.llm.common import documents, map_texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = {"assign": 0, "access": 1, "hex": 2, "random": 3}
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_RANDOM = 6, 20, 24, 16

DIGEST = re.compile(r"(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
                    r"|[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})")
PART = re.compile(rf"(?<![A-Za-z0-9+]){DIGEST.pattern}(?![A-Za-z0-9+])|[A-Za-z0-9+]+")
MAX_INNER = 4  # longest single token or number that a stretch goes on over


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


LOWER, DIGITS = bytes(range(97, 123)), bytes(range(48, 58))
HEX_TABLE = _table(DIGITS + b"abcdef")
RANDOM_TABLE = _table(LOWER + LOWER.upper() + DIGITS + b"+/_=-")
_ENCODERS: dict = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                            special_tokens={})
    return _ENCODERS[path]


def _runs(inside: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` true cells."""
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def _random_spans(run: str, encoder, max_chars_per_token: float) -> list[tuple[int, int]]:
    """The random spans of a run: itself, or stretches of its parts."""
    def tokens(text: str) -> int:
        return len(encoder.encode_ordinary(text))

    def efficient(text: str) -> bool:
        return len(text) > max_chars_per_token * tokens(text)

    def plain(piece: str) -> bool:
        return not re.search("[A-Za-z]", piece) or tokens(piece) == 1 or efficient(piece)

    if not re.search("[A-Za-z]", run):
        return []
    parts = [(m.start(), m.end(), bool(DIGEST.fullmatch(m[0])) or efficient(m[0]) or all(map(plain, m[0].split("+"))))
             for m in PART.finditer(run)]
    odd = [(s, e) for s, e, ordinary in parts if not ordinary]
    if not odd:
        return []
    if not efficient(run):
        return [(0, len(run))]
    stretches, joined = [], False
    for s, e, ordinary in parts:
        if not ordinary and joined:
            stretches[-1].append((s, e))
        elif not ordinary:
            stretches.append([(s, e)])
        joined = not ordinary or joined and e - s <= MAX_INNER and plain(run[s:e])
    out = []
    for members in stretches:
        start, end = members[0][0], members[-1][1]
        if end - start >= MIN_RANDOM and not efficient(run[start:end]):
            out.append((start, end))
        else:
            out += [(s, e) for s, e in members if e - s >= MIN_RANDOM]
    return out


def _rests(start: int, end: int, spans: list) -> list[tuple[int, int]]:
    """What ``spans`` leave of [start, end), of at least MIN_RANDOM characters."""
    out, at = [], start
    for s, _, e in sorted(spans):
        if e > at and s < end:
            out.append((at, s))
            at = e
    return [(s, e) for s, e in [*out, (at, end)] if e - s >= MIN_RANDOM]


def find_spans(texts: list[str], encoder, max_chars_per_token: float) -> list[list[tuple[int, int, str]]]:
    """Per text (start, kind number, end) ordered, for all kinds."""
    raw = [t.encode() for t in texts]
    joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    found: list[list] = [[] for _ in texts]
    for doc, text in enumerate(texts):
        if ASSIGN_HINT.search(text):
            found[doc] += [(m.start(), KINDS["assign"], m.end()) for m in ASSIGN.finditer(text)
                           if len(m[2]) >= MIN_ASSIGN]
        if "AKIA" in text:
            found[doc] += [(m.start(), KINDS["access"], m.end()) for m in ACCESS.finditer(text)
                           if len(m[0]) >= MIN_ACCESS]

    def place(start: int, end: int) -> tuple[int, int, int]:
        doc = int(np.searchsorted(offsets, start, "right")) - 1
        at = len(raw[doc][: start - offsets[doc]].decode())
        return doc, at, at + end - start  # the run itself is ASCII

    for run in _runs(HEX_TABLE[joined], MIN_HEX):
        doc, start, end = place(*run)
        found[doc].append((start, KINDS["hex"], end))
    verdicts: dict[str, list] = {}
    base = [list(f) for f in found]
    for run in _runs(RANDOM_TABLE[joined], MIN_RANDOM):
        doc, (first, last) = int(np.searchsorted(offsets, run[0], "right")) - 1, run
        chars, rests = joined[first:last].tobytes().decode(), [(0, last - first)]
        if base[doc]:
            _, start, end = place(first, last)
            rests = [(s - start, e - start) for s, e in _rests(start, end, base[doc])]
        for at, to in rests:
            rest = chars[at:to]
            if rest not in verdicts:
                verdicts[rest] = _random_spans(rest, encoder, max_chars_per_token)
            for s, e in verdicts[rest]:
                _, start, end = place(first + at + s, first + at + e)
                found[doc].append((start, KINDS["random"], end))
    return [sorted(f) for f in found]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
         max_chars_per_token: float = 2.3, carry: list[str] | None = None) -> DataFrame:
    """id, ``carry``, n_assign, n_access, n_hex, n_random, base_sha256, spans,
    found array<struct<kind, start, end, text>>."""
    path = vocabulary or vocabulary_path()
    names = list(KINDS)

    def run(texts):
        every = find_spans(texts, _encoder(path), max_chars_per_token)
        show = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
        counts = [pa.array([sum(x[1] == k for x in spans) for spans in every], pa.int64()) for k in KINDS.values()]
        base = [hashlib.sha256(show([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans in every]
        rows = [[{"kind": names[k], "start": s, "end": e, "text": t[s:e]} for s, k, e in spans]
                for t, spans in zip(texts, every)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("text", pa.string())]))
        return [*counts, pa.array(base), pa.array([show(x) for x in every]), pa.array(rows, kind)]

    return map_texts(df, id_col, text_col,
                     "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, "
                     "found array<struct<kind:string,start:long,end:long,text:string>>", run, carry)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("found")


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLE: dict[str, str] = {}
