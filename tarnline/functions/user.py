"""Functions of the user's in Python, by Arrow batches: scalar, aggregate and table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def shout(names: pa.Array) -> pa.Array:
    """In upper case, with a mark; null stays null."""
    return pc.binary_join_element_wise(pc.utf8_upper(names), "!", "")


def geometric_mean(df: DataFrame, by: str, value: str) -> DataFrame:
    """by and mean: the geometric mean of each group's positive values, null if it has none.

    The first phase folds each batch to a row a group where the rows are, so that what is shuffled does not grow with a group.
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(value).cast("float64")
            logs = pc.ln(pc.if_else(pc.greater(x, 0), x, None))
            some = pa.table({by: batch.column(by), "x": logs}).group_by(by).aggregate([("x", "sum"), ("x", "count")])
            yield from some.select([by, "x_sum", "x_count"]).rename_columns([by, "logs", "n"]).to_batches()

    kind = df.schema[by].dataType.simpleString()
    parts = df.select(by, value).mapInArrow(folded, f"{by} {kind}, logs double, n long")
    return parts.groupBy(by).agg(F.exp(F.try_divide(F.sum("logs"), F.sum("n"))).alias("mean"))


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
class word_spans:  # noqa: N801
    """Words between single spaces, with where they stand; no rows for null."""

    def eval(self, text: str):
        at = 0
        for w in text.split(" ") if text is not None else ():
            yield w, at, at + len(w)
            at += len(w) + 1


