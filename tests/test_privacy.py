"""Golden pseudonyms against the standard library's HMAC."""

import hashlib
import hmac

from pyspark.sql import functions as F

from wardflow.functions.derive import stay_key
from wardflow.plans import privacy as pv
from wardflow.sources.layouts import WEEKLY

SECRET = b"a-test-key"


def _digest(text):
    return hmac.new(SECRET, text.encode(), hashlib.sha256).hexdigest()


def _chunk(digest, i, modulus):
    return int(digest[12 * i : 12 * i + 12], 16) % modulus


def test_golden_values(spark):
    rows = spark.createDataFrame([("000123", "15031980", "68100"), ("N77", "99999999", "2A004"), ("0", "01012000", "00000")], "stay string, birth string, cp string")
    got = rows.select(
        "stay", "birth", "cp", stay_key(F.col("stay")).alias("key"), pv.hmac_hex(SECRET, F.col("stay")).alias("h"), pv.pseudonym(SECRET, "nda", F.col("stay"), 20).alias("p"),
        pv.shifted_birth_date(SECRET, F.col("stay"), F.col("birth")).alias("b"), pv.random_postcode(SECRET, F.col("stay"), F.col("cp")).alias("c"),
    ).collect()
    for r in got:
        assert r.h == _digest(r.stay)
        if r.stay.isdigit():
            d = _digest(f"nda:{r.key}")
            assert r.p == "".join(f"{_chunk(d, i, 10**9):09d}" for i in range(3))[:20]
        else:
            d = _digest(f"nda:{r.stay}")
            n = len(pv.ALPHABET)
            assert r.p == "".join(pv.ALPHABET[_chunk(d, i // 8, n**8) // n ** (i % 8) % n] for i in range(20))
        assert r.c == (f"{r.cp[:2]}{_chunk(_digest(f'cp:{r.key}:{r.cp}'), 0, 1000):03d}" if r.cp.isdigit() else r.cp)
    shifted = {r.stay: r.b for r in got}
    assert shifted["N77"] == "99999999" and shifted["000123"] != "15031980" and shifted["000123"][4:] == "1980"


def test_key_is_not_in_plans(spark, tmp_path):
    """A stored key gives the same values as a literal one, and none of its forms stands in any plan."""
    path = str(tmp_path / "key")
    pv.write_key(spark, SECRET, path)
    rows = spark.createDataFrame([("000123", "15031980", "68100"), ("N77", "99999999", "2A004")], "numero_admin_sejour string, birth string, cp string")
    columns = lambda key: [pv.pseudonym(key, "nda", F.col("numero_admin_sejour"), 20), pv.shifted_birth_date(key, F.col("numero_admin_sejour"), F.col("birth")), pv.random_postcode(key, F.col("numero_admin_sejour"), F.col("cp"))]
    hidden = pv.with_key(rows, path).select(*columns(pv.KEY))
    assert hidden.collect() == rows.select(*columns(SECRET)).collect()
    masked = pv.mask_valuation(rows, path)
    assert masked.columns == rows.columns and masked.collect() == pv.mask_valuation(rows, SECRET).collect()
    for df in (hidden, masked):
        plan = df._jdf.queryExecution()
        text = plan.toString() + plan.optimizedPlan().toJSON() + plan.executedPlan().toString()
        for form in (SECRET, *pv.key_forms(SECRET)):
            start = form[: len(SECRET)]
            assert start.hex().upper() not in text.upper() and start.decode("latin-1") not in text and str(list(start))[1:-1] not in text
    spark.createDataFrame([(b"a", b"b")] * 2, "inner binary, outer binary").write.parquet(str(tmp_path / "two"))
    try:
        pv.with_key(rows, str(tmp_path / "two"))
    except ValueError as error:
        assert "one row" in str(error)
    else:
        raise AssertionError("two keys were taken")


def test_mask_makes_each_digest_once(spark):
    """three digests a line, whatever the version, and none of them once more in a filter."""
    lines = spark.createDataFrame([(v, i) for i, v in enumerate(["M1D", "M1C", "M1B", "M9Z"])], "v string, line_no int").selectExpr(
        "'f' source_file", "line_no", "concat(repeat(' ', 10), v, repeat(' ', 19), lpad(cast(line_no as string), 9, '0'), repeat(' ', 20), rpad('', 140, '0102193801000')) line")
    masked = pv.slices(pv.mask_weekly(lines, b"s"), WEEKLY, "numero_admin_sejour")
    assert masked._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 6
    assert sorted(r.line_no for r in masked.collect()) == [0, 1, 2]
    untouched = pv.mask_weekly(lines, b"s").where("line_no = 3").join(lines, ["line_no", "line"])
    assert untouched.count() == 1


def test_leak_check_reads_each_side_once(spark):
    """counts and shared values come from one aggregate over both sides."""
    real = spark.createDataFrame([("1",), ("2",), ("2",), (None,), ("000",), ("",)], "value string")
    check = lambda *values: pv.leak_check(real, spark.createDataFrame([(v,) for v in values], "value string")).collect()[0]
    assert tuple(check("3", "4", "4", None, "000", "")) == (6, 6, 0, True)
    assert tuple(check("2", "2", "4", None, "000", "")) == (6, 6, 1, False)
    assert tuple(check("3")) == (6, 1, 0, False)
    empty = spark.createDataFrame([], "value string")
    assert tuple(pv.leak_check(empty, empty).collect()[0]) == (0, 0, 0, False)
    plan = pv.leak_check(real, real)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2 and "scalar-subquery" not in plan
