"""The most frequent values of columns of any cardinality, exactly, without shuffling them all where some stand out.

Each task keeps a Misra-Gries summary of at most ``capacity`` values of its rows. What a summary dropped of a value is at most its
error, and the errors add up, so the sum over tasks of a value's counters is short of its count by ``error`` at most, and a
value in no summary has at most ``error`` rows. If the n-th of those sums is more than ``error``, no value was left out, ties
included: a second pass counts the candidates exactly, and what is shuffled is bounded by tasks x capacity. If not, no n values
stand out, and the second pass counts all values, each task's once; so there are two passes at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import Scratch

CAPACITY = 1000


def summaries(rows: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Misra-Gries summaries of the tasks: keys, ``__count``, and once for each task a row without keys and its ``__error``."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType(rows.select(*keys).schema.fields).add("__count", "long").add("__error", "long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        kept, error = None, 0
        for batch in batches:
            counted = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([([], "count_all")]).rename_columns([*keys, "__count"])
            both = counted if kept is None else pa.concat_tables([kept, counted]).group_by(keys, use_threads=False).aggregate([("__count", "sum")]).rename_columns([*keys, "__count"])
            if both.num_rows > capacity:
                counts = both.column("__count").to_numpy()
                least = int(counts[counts.argsort()[-capacity - 1]])
                error += least
                both = both.set_column(len(keys), "__count", pa.array(counts - least)).filter(pa.array(counts > least))
            kept = both
        if kept is not None:
            out = kept.append_column("__error", pa.nulls(kept.num_rows, pa.int64()))
            yield from out.cast(arrow).to_batches()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in arrow][:-1] + [pa.array([error], pa.int64())], schema=arrow)

    return rows.select(*keys).mapInArrow(run, schema)


def most_frequent(rows: DataFrame, keys: list[str], n: int, capacity: int = CAPACITY, name: str = "n") -> DataFrame:
    """The n most frequent values of the keys and their exact counts, ties by the keys (nulls first); nulls are values.

    ``rows`` is read twice: give a table or a cheap plan.
    """
    order = [F.col(name).desc(), *[F.col(k).asc_nulls_first() for k in keys]]
    counted = lambda df: df.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(*order).limit(n)
    with Scratch(rows.sparkSession) as own:
        made = own.write(summaries(rows, keys, capacity), "summaries")
        error = made.agg(F.sum("__error")).first()[0] or 0
        lower = own.write(made.where("__error is null").groupBy(*keys).agg(F.sum("__count").alias("__least")), "candidates")
        # the n-th lower bound: a value that can't reach it is out
        bar = lower.orderBy(F.col("__least").desc()).limit(n).agg(F.count("*").alias("n"), F.min("__least").alias("bar")).first()
        if error and (bar.n < n or bar.bar <= error):
            top = counted(rows.select(*keys))
        else:
            wanted = lower.where(F.col("__least") + F.lit(error) >= F.lit(bar.bar if bar.n == n else 0)).select(*[F.col(k).alias(f"__{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
            top = counted(rows.select(*keys).join(wanted, same, "left_semi"))
        return own.keep(top, "most-frequent").orderBy(*order)
