"""Period joins do not shuffle a fact table on its few establishments."""

import re

from pyspark.sql import functions as F

from wardflow.plans import periods as per
from wardflow.plans import valuation as val
from wardflow.session import run_folder


def test_stored_periods_are_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        path = run_folder(spark, "period-test")
        spark.createDataFrame([("f", 2025, 1, 20)], "finess_epmsi string, iso_year int, min_week int, max_week int").selectExpr(
            "*", "date'2024-12-30' start", "date'2025-05-18' `end`"
        ).write.parquet(path)
        periods = spark.read.parquet(path)
        facts = spark.range(100).select(F.lit("f").alias("finess_epmsi"), F.lit(2025).alias("iso_year"), F.col("id").cast("int").alias("week"), F.lit(2025).alias("campagne"),
                                        F.lit("1").alias("stay"), F.lit("2025-01-02").alias("date_entree"), F.lit(None).cast("string").alias("date_sortie"), F.expr("date'2024-12-30'").alias("monday"), F.expr("array(1, 0, 2, 0, 0, 0, 0)").alias("days"), F.expr("cast(1 as decimal(31,12))").alias("rate"))
        facts.write.parquet(f"{path}-facts")
        facts = spark.read.parquet(f"{path}-facts")
        weeks, rest = facts.drop("campagne"), facts.drop("iso_year")
        for df in (per.weeks_in_period(weeks, periods), per.campaigns_in_period(rest, periods), per.stays_in_period(rest, periods), val.value_in_period(rest, periods)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan
            assert not re.search(r"hashpartitioning\(finess_epmsi#\d+(, (iso_year|campagne)#\d+)?, \d+\), ENSURE_REQUIREMENTS[^\n]*\n[^\n]*(Range|Scan)", plan)
        assert per.weeks_in_period(weeks, periods).count() == 20
        assert val.value_in_period(rest, periods).first().montant_br_pt == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
