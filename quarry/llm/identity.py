"""What tells rows apart where ids may be null or repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(docs: DataFrame) -> list[Column]:
    """``_a`` and ``_b``: 128 bits of hash over all columns of a row and their nulls; equal rows have equal keys."""
    cols = [F.to_json(F.struct(docs[f.name])) if "map<" in f.dataType.simpleString() else docs[f.name]
            for f in docs.schema.fields]
    # a null leaves the hash as it is
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    return [F.xxhash64(F.lit(i), nulls, *cols).alias(name) for i, name in enumerate(("_a", "_b"))]


def distinct_rows(docs: DataFrame) -> DataFrame:
    """(_a, _b, row): every different row once, as a struct, so that no name of its columns can clash."""
    row = F.struct(*[docs[c] for c in docs.columns])
    return docs.select(*row_key(docs), row.alias("row")).groupBy("_a", "_b").agg(F.first("row").alias("row"))
