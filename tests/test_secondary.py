"""Secondary dashboards: memberships of a record and the shared scan."""

from pyspark.sql import functions as F

from wardflow.plans import dashboard as dash


def test_memberships(spark):
    rows = spark.createDataFrame([(1, "A", "1"), (2, "N", "3"), (3, " ", "2"), (4, None, None), (5, "Z", "")], "k int, numero_unite_medicale string, type_hospitalisation string")
    got = sorted((r.k, r.axis, r.axis_value) for r in dash.with_axes(rows, {"x": ["A", "N"], "y": ["N"], "none": []}).collect())
    assert got == [
        (1, "group", "x"), (1, "hosp", "1"), (1, "unit", "A"), (2, "group", "x"), (2, "group", "y"), (2, "hosp", "2"), (2, "unit", "N"), (3, "hosp", "2"), (5, "unit", "Z"),
    ]


def test_axis_sections_agree_with_filtered_ones(spark):
    """A section by axis is the section of the records of each axis value alone."""
    data = [("f", 2024, f"{n:03d}", "012024", 3 + n % 4, u, "E" if n % 3 == 0 else None, n % 2) for n in range(30) for u in ("A", "B")]
    records = spark.createDataFrame(data, "finess_epmsi string, iso_year int, numero_admin_sejour string, numero_semaine string, n_days int, numero_unite_medicale string, indicateur_erreur string, n2_nb_csarr int")
    records = records.withColumn("type_hospitalisation", F.lit("1"))
    by = ["finess_epmsi", "iso_year", *dash.AXES]
    whole = {(r.axis, r.axis_value): r for r in dash.records_without_acts(dash.with_axes(records, {"both": ["A", "B"]}), by).collect()}
    assert whole.keys() == {("unit", "A"), ("unit", "B"), ("hosp", "1"), ("group", "both")}
    for (axis, value), row in whole.items():
        alone = dash.records_without_acts(records.where(F.col("numero_unite_medicale") == value) if axis == "unit" else records).first()
        assert all(row[c] == alone[c] for c in alone.asDict())
