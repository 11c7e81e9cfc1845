"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dexspark.sources.shared import shared_path

pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back to the system

#: Rows and bytes of an Arrow batch.
BATCH, BATCH_BYTES = 16384, 2 << 20
#: Odd multiplier of the rolling word-sequence hash.
ROLL = np.uint64(0x9E3779B97F4A7C15)


def own_names(docs: DataFrame, kept: list[str]) -> list[F.Column]:
    """The kept columns as k0, k1 and so on, so that no name of theirs clashes with an operator's."""
    return [F.col("`" + name.replace("`", "``") + "`").alias(f"k{n}") for n, name in enumerate(kept)]


def beside_text(docs: DataFrame, kept: list[str]) -> tuple[DataFrame, list[str]]:
    """docs as k0, k1 and so on for the kept columns but text, then text as a string; and the kept columns' names there."""
    names = ["text" if name == "text" else f"k{n}" for n, name in enumerate(kept)]
    own = [c for c, n in zip(own_names(docs, kept), names) if n != "text"]
    return docs.select(*own, F.col("text").cast("string").alias("text")), names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> None:
    """Texts can be long: bound Arrow batches by their bytes. Spark reads these settings when the plan runs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts its lineage."""
    path = shared_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks_for(rows: int, per_block: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_block))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that what a task builds from one of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words; empty if there are fewer."""
    count = len(hashes) - n + 1
    if count < 1:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out = out * ROLL + hashes[k : k + count]
    return out


@contextmanager
def no_cycles() -> Iterator[None]:
    """While a task fills a store of many small dictionaries without cycles, searching it for cycles is half of the work."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the place of the text that each word is from."""
    split = [(t or b"").split() for t in texts]
    return word_hashes([w for words in split for w in words]), np.repeat(np.arange(len(split)), list(map(len, split)))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for clusters that lack it."""
    sc = spark.sparkContext
    if any(name.startswith("dexspark-") for name in sc._python_includes):
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp()) / f"dexspark-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    sc.addPyFile(str(path))
