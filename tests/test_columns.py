import datetime

from pyspark.sql import functions as F

from switchyard.functions import columns as co


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_month_diff_counts_boundaries_both_ways(spark):
    d = datetime.date
    f = spark.createDataFrame([(d(2024, 3, 1), d(2024, 1, 31)), (d(2024, 1, 31), d(2024, 3, 1)), (d(2025, 1, 1), d(2024, 12, 31))], "a date, b date")
    assert rows(f.select(co.month_diff(F.col("a"), F.col("b")))) == [(2,), (-2,), (1,)]


def test_null_rules_of_provider_buckets_and_flags(spark):
    f = spark.createDataFrame([("GOOGLE_PAY", 1), ("card", 2), (None, None)], "p string, n int")
    got = rows(f.select(co.provider_listed(F.col("p"), ["GOOGLE_PAY"]), co.provider_like(F.col("p"), {"%GOOGLE%": "gp"}), co.first_payment_flag(F.col("n")), co.country_flag(F.col("p"))))
    assert got == [("GOOGLE_PAY", "gp", "1", "Non-USA"), ("non_wallet", "non_wallet", "2+", "Non-USA"), (None, "non_wallet", "1", "Non-USA")]


def test_amounts_between_bands_are_errors(spark):
    schema = "amount double, transaction string, payment string, method string, product_group string, processor string, gateway_processor string"
    f = spark.createDataFrame([(a, "auth", "order", "creditcard", None, None, None) for a in (11.0, 12.0, 13.0, 37.0, 39.0, None)], schema)
    got = [r[0] for r in rows(co.attempt_type(f).select("rpgt"))]
    assert got == ["Monthly Initial", "Error", "Annual Sub Sale", "Error", "Upgrades", "Error"]


def test_like_underscore_is_a_wildcard(spark):
    f = spark.createDataFrame([("MASTER-CARD",), ("American_Express",), (None,), ("visa",)], "s string")
    assert [r[0] for r in rows(f.select(co.account_type(F.col("s"))))] == ["mastercard", "amex", "unknown", "visa"]


def test_keys_shares_and_percent(spark):
    f = spark.createDataFrame([(" AbC ", "400022.0", "7.5%"), (None, "x.0y", "n/a")], "a string, b string, c string")
    assert rows(f.select(co.composite_key([F.col("a"), F.col("b")]), co.percent(F.col("c")))) == [("abc|400022", 7.5), ("unknown|x.0y", None)]
    z = spark.createDataFrame([("k", 0.0), ("k", 0.0)], "k string, v double")
    assert [rows(z.select(co.share_of("v", ["k"], how)))[0][0] for how in ("zero", "keep", "even")] == [0.0, 0.0, 0.5]


def test_aliases_that_meet_are_coalesced(spark):
    f = spark.createDataFrame([(None, "b", 1), ("a", "c", 2)], "BIN string, bank string, n int")
    out = co.normalise_columns(f, {"bank": ["bin"]})
    assert sorted(out.columns) == ["bank", "n"] and {tuple(r) for r in out.select("bank", "n").collect()} == {("b", 1), ("c", 2)}


def test_template_columns_and_scheme_codes(spark):
    assert co.gateway_columns(["BIN", "Currency", "gw_1", "_sheet", "GW 2"], ["bin", "currency"]) == ["gw_1", "GW 2"]
    f = spark.createDataFrame([(" VISA ",), ("mastercard",), (None,), ("",)], "s string")
    assert [r[0] for r in rows(f.select(co.scheme_code(F.col("s"))))] == ["vi", "non-vi", "vi", "non-vi"]
