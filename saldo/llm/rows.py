"""Rows named by id and text, for stages that drop documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_mark(text: Column) -> Column:
    """Tells rows apart that share an id; the id stays the key, so a clash needs equal ids too."""
    return F.xxhash64(text)


def whole_rows(df: DataFrame) -> Column:
    """All columns of a row as one, so that working columns cannot clash with them; ``select(name.*)`` undoes it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs named in kept (doc_id, mark), each once, with the columns of docs.

    Of rows that repeat an id and a text one stays, which one is open. The join deals rows out by id and
    mark; the count of repeated rows uses the same partitions.
    """
    key, absent = F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)), F.col(id_col).isNull()
    marked = docs.select(whole_rows(docs).alias("doc"), key.alias("id"), absent.alias("absent"), text_mark(F.col(text_col)).alias("mark"))
    names = kept.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("absent"), "mark")
    # Plain keys, nulls told apart by a flag: the window below then finds the rows dealt out as it needs them.
    keys = ["id", "absent", "mark"]
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    return marked.join(names, keys, "left_semi").withColumn("n", again).where("n = 1").select("doc.*")
