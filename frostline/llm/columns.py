"""Column expressions and small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of ASCII white space; everything between them is a word.
BLANKS = r"[\x20\x09-\x0D]+"


def quoted(name: str) -> str:
    """A column name that may hold dots or blanks, as ``F.col`` takes it."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that working columns cannot clash with given names."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row")


def unpacked(df: DataFrame, columns: list[str], extra: str) -> DataFrame:
    """Undo ``whole_row``: the given columns, with the result column ``extra`` in place of one of the same name."""
    return df.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in columns if c.lower() != extra.lower()], extra)


def given(text: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def total(values: Column) -> Column:
    """Sum of an array of longs; 0 for an empty one."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def hashed_grams(tokens: Column, k: int) -> Column:
    """64-bit hashes of all runs of ``k`` words, in order; a shorter text has none."""
    starts = F.slice(tokens, 1, F.greatest(F.size(tokens) - (k - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(tokens, i + j) for j in range(1, k)]))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_digest(text: Column) -> Column:
    """First 64 bits of the SHA-256 digest, for keys that must not depend on a session."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def portions(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes in one column each, at least one row; parts are copies."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
    for a, b in zip([0, *edges], [*edges, len(sizes)]):
        if b > a:
            yield batch if b - a == batch.num_rows else batch.take(pa.array(np.arange(a, b)))


def arrow_rows(df: DataFrame, inputs: dict[str, Column], result: T.StructField | list[T.StructField],
               work: Callable[[list[pa.Array]], pa.Array | list[pa.Array]], limit: int = 4 << 20) -> DataFrame:
    """Add result columns that ``work`` finds from the input columns of each row, in Arrow batches.

    Given columns of a result's name are replaced, all others stay. They pass by position under plain names, since
    ``mapInArrow`` looks columns up by name and would trip over dots, repeated names and names used inside. ``work`` gets
    the input columns of batches of about ``limit`` bytes in the last of them.
    """
    results = result if isinstance(result, list) else [result]
    new = {f.name.lower() for f in results}
    kept = [c for c in df.columns if c.lower() not in new]
    fields = {f.name: f for f in df.schema.fields}
    plain = [f"c{k}" for k in range(len(kept))]
    passed = df.select(*[F.col(quoted(c)).alias(p) for c, p in zip(kept, plain)],
                       *[value.alias(f"in_{name}") for name, value in inputs.items()])
    schema = T.StructType([*[T.StructField(p, fields[c].dataType, fields[c].nullable) for c, p in zip(kept, plain)],
                           *[T.StructField(f"out{k}", f.dataType) for k, f in enumerate(results)]])
    names, n = schema.names, len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, whole.num_columns - 1, limit):
                found = work(batch.columns[n:])
                found = found if isinstance(found, list) else [found]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *found], names)

    return passed.mapInArrow(run, schema).toDF(*kept, *[f.name for f in results])
