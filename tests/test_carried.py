"""Columns that a chain of joins only carries along."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.operators import counts
from clickloom.operators.keyed import PACK_FROM, Pack

KEYS = ["k0", "k1", "k2", "k3", "k4"]


def wide(spark):
    """Rows with null and repeated keys, and columns of three types that no join needs, nulls among them."""
    rows = spark.range(0, 400, 1, 3).withColumnRenamed("id", "instance_id")
    rows = rows.withColumns({k: F.when(F.col("instance_id") % 11 != i, F.col("instance_id") % (i + 3)) for i, k in enumerate(KEYS)})
    rows = rows.withColumns({f"w{i}": F.when(F.col("instance_id") % 7 != i % 7, F.col("instance_id") * i) for i in range(PACK_FROM)})
    rows = rows.withColumns({f"s{i}": F.concat(F.lit("s"), F.col(f"w{i}")) for i in range(3)})
    return rows.withColumns({f"d{i}": F.col("instance_id") / (i + 1) for i in range(3)})


def test_joins_do_not_repeat_the_columns_they_carry(spark):
    out = counts.attach_counts(wide(spark), {f"{k}_all": k for k in KEYS})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("AS w7#" in line or " w7#" in line or ", w7#" in line for line in plan.splitlines()) <= len(KEYS)


def test_carried_columns_keep_their_values_types_and_places(spark):
    df = wide(spark)
    out = counts.attach_counts(df, {f"{k}_all": k for k in KEYS})
    assert out.columns == [*df.columns, *[f"{k}_all" for k in KEYS]]
    assert dict(out.dtypes).items() >= dict(df.dtypes).items()
    assert sorted(map(str, out.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    for k in KEYS:
        plain = df.dropna(subset=[k]).groupBy(k).count()
        found = out.dropna(subset=[k]).select(k, f"{k}_all").distinct()
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
        assert out.where(F.col(k).isNull() & F.col(f"{k}_all").isNotNull()).isEmpty()


def test_few_columns_stay_as_they_are(spark):
    df = wide(spark).select("instance_id", *KEYS, "w1", "w2")
    assert Pack(df, KEYS).df.columns == df.columns
