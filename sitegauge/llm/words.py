"""Words of texts as tasks read them from Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
# Bytes that part words: ASCII other than letters and digits.
PARTING = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_in(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z in lower case: runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.lower().translate(PARTING).split()


def each_text(column) -> Iterator[bytes]:
    """The texts of an Arrow string column in UTF-8, one at a time; null is empty."""
    import pyarrow as pa

    for text in column.cast(pa.binary()):
        yield text.as_py() or b""


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def new_name(df: DataFrame, name: str) -> str:
    """``name`` with so many underscores before it that no column has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def bound_batches(spark: SparkSession) -> None:
    """Let no batch of rows that goes to Python exceed ``BATCH_BYTES``, however long the texts; a session's own limit stays."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
