"""Shared helpers of the text operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.session import ensure_checkpoint_dir
from transitlake.sources.tables import read_table

SLICE_BYTES = 2 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def write_table(df: DataFrame, name: str, codec: str = "snappy", group_bytes: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and reread it:
    lineage is cut, an executor lost later costs only a reread, and the shuffle
    files behind the table are dropped as soon as it is written.  ``group_bytes``,
    for rows of many MB: sizes are looked at after every row (else after 100 at the
    soonest) and row groups end there; writer and reader hold a whole one."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        sized = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1} if group_bytes else {}
        df.write.options(**sized).parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table of ``write_table`` that nothing reads any
    more: all that was made of it has been written itself."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts of at most BATCH_ROWS rows and about
    BATCH_BYTES, unless the session already asks for smaller ones."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"\d+$", spark.conf.get(key))  # the default, or a size with a unit, is replaced
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


def text_slices(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches so that one slice holds at most about SLICE_BYTES of
    text (a longer text is a slice of its own); nulls read as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > SLICE_BYTES:
                yield _cut(batch, start, i, text)
                start, held = i, 0
            held += int(size)
        yield _cut(batch, start, batch.num_rows, text)


def _cut(batch: pa.RecordBatch, start: int, stop: int, text: int):
    part = batch.slice(start, stop - start)
    return part, [x or "" for x in part.column(text).to_pylist()]


def own_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it until no column of ``taken`` has it
    (Spark's names do not tell case apart)."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``df`` with columns renamed whose names an operator's inner ones (``__...``)
    could equal or that are no plain words; the name that each column has now; and
    the function that gives an output its given names back."""
    now: dict[str, str] = {}
    for c in df.columns:
        plain = re.fullmatch(r"\w+", c) and not c.startswith("__")
        now[c] = c if plain else own_name("own_" + re.sub(r"\W", "_", c), [*df.columns, *now.values()])
    if all(k == v for k, v in now.items()):
        return df, now, lambda out: out
    given = {v: k for k, v in now.items()}
    return (df.toDF(*(now[c] for c in df.columns)), now,
            lambda out: out.toDF(*(given.get(c, c) for c in out.columns)))


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: str,
              per_slice: Callable[[list[str]], list[pa.Array]], carry: list[str] | None = None) -> DataFrame:
    """``df``'s id (and ``carry`` columns), then the columns that ``per_slice``
    makes of each slice of texts.  One Arrow pass, no shuffle."""
    bounded_batches(df.sparkSession)
    keep = [id_col, *(carry or [])]
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias(own_name("__text", keep)),
                    *[F.col(c) for c in carry or []])
    fields = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    out_schema = f"{fields}, {schema}"
    names = [*keep, *(x.split()[0].strip("`") for x in _top_level(schema))]

    def run(batches):
        for part, texts in text_slices(batches):
            arrays = [part.column(0), *(part.column(2 + k) for k in range(len(keep) - 1)), *per_slice(texts)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return src.mapInArrow(run, out_schema)


def _top_level(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += ch in "<(" 
        depth -= ch in ">)"
        if ch == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
