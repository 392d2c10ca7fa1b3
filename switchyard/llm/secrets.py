"""Secret scanning, on DataFrame functions alone.

Method: three patterns give base spans.  Other long runs of encoding characters are put to a battery of randomness tests under
their inferred encoding: chi-squared uniformity over the alphabet and over its character classes, runs about the middle
of the alphabet, and lag-one serial correlation, combined by Fisher's rule into one p-value of "uniformly random".
Discoveries are controlled by length: within each band of encoding and length, the ordinary strings above a cut-off are
estimated from their own tail, carried on from the two decades of p below 0.1 at the rate at which they thin out there, with
few counts smoothed towards all bands.  The least cut-off is taken whose estimated share of ordinary strings among the
declared ones is at most ``rate``, and the greatest where none is.

Scale: one pass of regular expressions over each text, written once, and no shuffle of the texts without long strings;
the cut-offs come from counts of distinct strings in a fixed number of bands, so the driver sees one row for each band.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.llm.scratch import stored

# The base patterns, the kinds in their order and the encodings' alphabets.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("lower36", "^[a-z0-9]+$", DIGITS + LOWER),
    ("upper36", "^[A-Z0-9]+$", DIGITS + UPPER),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", DIGITS + UPPER + LOWER + "+/"),
    ("base64url", "", DIGITS + UPPER + LOWER + "+/-_"),
]


@dataclass(frozen=True)
class Battery:
    """``rate``: estimated share of ordinary strings among the declared; ``cuts``: cut-offs to choose from, rising; ``pool``: distinct strings for which all bands together count in a band's tail; ``lengths``: lower ends of the length bands."""

    rate: float = 0.1
    cuts: tuple[float, ...] = (0.003, 0.01, 0.03, 0.1, 0.2, 0.3)
    pool: float = 40.0
    lengths: tuple[int, ...] = (20, 24, 32, 48, 96)


def _matches(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """Array of (start, end, value): leftmost matches in code points; ``group`` of fewer than ``least`` characters drops the match."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ok = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    ends = F.aggregate(
        F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"), ok.alias("part")),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string,keep:boolean>>)").alias("all")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.array_append(acc["all"], F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("value"), (F.length(x["part"]) >= least).alias("keep"))).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string,keep:boolean>>)")
    return F.filter(F.when(text.rlike(pattern), ends).otherwise(none), lambda x: x["keep"])


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal, by a logistic fit (absolute error under 2e-4)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070566 * z * z * z)))


def _chi_tail(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared, after Wilson and Hilferty."""
    v = F.lit(2.0) / (9 * df)
    return _tail((F.pow(F.greatest(x, F.lit(1e-9)) / df, F.lit(1 / 3)) - 1 + v) / F.sqrt(v))


def battery(strings: DataFrame) -> DataFrame:
    """``strings`` (value, ...) with encoding, n and p: p is small for strings that are not uniform over their alphabet."""
    token, which = F.col("value"), F.lit(len(ENCODINGS) - 1)
    for k in range(len(ENCODINGS) - 2, -1, -1):
        which = F.when(token.rlike(ENCODINGS[k][1]), F.lit(k)).otherwise(which)
    out = strings.withColumn("encoding", which)
    out = out.withColumn("alphabet", F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), F.col("encoding") + 1))
    out = out.withColumn("n", F.length(token)).withColumn("place", F.transform(F.split(token, ""), lambda c: F.position(c, "alphabet").cast("double")))
    n, a = F.col("n").cast("double"), F.length("alphabet").cast("double")
    without = lambda text, chars: F.length(F.regexp_replace(text, chars, ""))
    squares = F.aggregate(F.split("alphabet", ""), F.lit(0.0), lambda s, c: s + F.pow((F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"), F.lit(2.0)))
    out = out.withColumn("uniform", _chi_tail(squares * a / n - n, a - 1))

    parts, present = F.lit(0.0), F.lit(0.0)
    for pattern in ("[0-9]", "[a-z]", "[A-Z]"):
        size = F.length("alphabet") - without(F.col("alphabet"), pattern)
        expected = F.greatest(n * size / a, F.lit(1e-9))
        parts = parts + F.when(size > 0, F.pow(F.length(token) - without(token, pattern) - expected, F.lit(2.0)) / expected).otherwise(0.0)
        present = present + F.when(size > 0, 1.0).otherwise(0.0)
    out = out.withColumn("parts", parts).withColumn("classes", _chi_tail(F.col("parts"), F.greatest(present - 1, F.lit(1.0))))

    later, earlier = F.slice("place", F.lit(2), F.size("place") - 1), F.slice("place", F.lit(1), F.size("place") - 1)
    half = a / 2 + 0.5
    changes = F.aggregate(F.zip_with(earlier, later, lambda x, y: F.when((x > half) != (y > half), 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("runs", 2 * _tail(F.abs(changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)))
    mean, spread = (a + 1) / 2, (a * a - 1) / 12
    lag = F.aggregate(F.zip_with(earlier, later, lambda x, y: (x - mean) * (y - mean)), F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("serial", 2 * _tail(F.abs(lag / spread) / F.sqrt(n - 1)))

    fisher = F.lit(0.0)
    for p in ("uniform", "classes", "runs", "serial"):
        fisher = fisher - 2 * F.log(F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(1e-12)))
    return out.withColumn("p", _chi_tail(fisher, F.lit(8.0))).drop("alphabet", "place", "parts", "uniform", "classes", "runs", "serial")


def _limits(bands: list[tuple[int, int, list[int]]], b: Battery) -> dict[int, float]:
    """Cut-offs by band, from (band, distinct strings, how many have p over 0.5, 0.1, 0.01, 0.001 and each of ``cuts``)."""
    tails = {}
    for band, n, (half, tenth, hundredth, thousandth, *_) in bands:
        random = 2 * half  # they are uniform, so 9 % and 0.9 % of them lie in the two decades
        tails[band] = max(n - random, 1), max(hundredth - tenth - 0.09 * random, 0.0), max(thousandth - hundredth - 0.009 * random, 0.0)
    every, upper, lower = (sum(x) for x in zip(*tails.values(), strict=True)) if tails else (0, 0.0, 0.0)
    share, thinner = (upper + 1) / (every + b.pool), (upper + 1) / (lower + 2)
    out = {}
    for band, _, over in bands:
        n, upper, lower = tails[band]
        there = n * (upper + b.pool * share) / (n + b.pool)  # ordinary strings with p from 0.01 to 0.1
        q = (upper + b.pool * thinner) / (lower + b.pool)
        depth = [-math.log10(c) for c in b.cuts]
        ordinary = [there * (t if abs(1 - q) < 1e-6 else q * q * (q**-t - 1) / (1 - q)) for t in depth]
        out[band] = next((c for c, x, found in zip(b.cuts, ordinary, over[4:], strict=True) if found and x <= b.rate * found), b.cuts[-1])
    return out


def judged(strings: DataFrame, b: Battery) -> DataFrame:
    """Distinct ``value``s -> (value, declared): the battery with a cut-off for each band, from all strings."""
    step = F.lit(0)
    for least in b.lengths[1:]:
        step = step + F.when(F.col("n") >= least, 1).otherwise(0)
    tested = stored(battery(strings.select("value").distinct()).select("value", "p", (F.col("encoding") * len(b.lengths) + step).alias("band")), "battery")
    counts = [F.sum((F.col("p") > c).cast("long")).alias(f"over_{k}") for k, c in enumerate((0.5, 0.1, 0.01, 0.001, *b.cuts))]
    bands = tested.groupBy("band").agg(F.count(F.lit(1)).alias("all"), *counts).collect()  # one row for each band
    limit = F.lit(b.cuts[-1])
    for band, cut in _limits([(r["band"], r["all"], [r[f"over_{k}"] for k in range(4 + len(b.cuts))]) for r in bands], b).items():
        limit = F.when(F.col("band") == band, F.lit(cut)).otherwise(limit)
    return tested.select("value", (F.col("p") > limit).alias("declared"))


def scanned(docs: DataFrame, b: Battery = Battery()) -> DataFrame:
    """``docs`` with two more columns, ``_base`` and ``_spans``: arrays of (start, kind, end) in code points, end exclusive.

    A random span that overlaps a base span is left out.  Null or empty texts have no spans.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = lambda found, kind: F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    base = F.array_sort(F.concat(plain(_matches(text, ASSIGN, 2, 6), 0), plain(_matches(text, ACCESS), 1), plain(_matches(text, HEX), 2)))
    rows = docs.withColumn("_base", base).withColumn("_long", _matches(text, RANDOM, None, 20)).withColumn("_row", F.monotonically_increasing_id())
    rows = stored(rows, "scan")
    quiet, open_ = rows.where("size(_long) = 0"), rows.where("size(_long) > 0")
    each = open_.select("_row", "_base", F.explode("_long").alias("x")).select("_row", "_base", "x.*")
    each = stored(each.where(~F.exists("_base", lambda y: (F.col("start") < y["end"]) & (y["start"] < F.col("end")))).select("_row", "start", "end", "value"), "strings")
    chosen = each.join(judged(each, b).where("declared"), "value").groupBy("_row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("_random"))
    more = open_.join(chosen, "_row", "left").withColumn("_spans", F.array_sort(F.concat("_base", F.coalesce("_random", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")))))
    return quiet.withColumn("_spans", F.col("_base")).drop("_long", "_row").unionByName(more.drop("_long", "_row", "_random"))


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, b: Battery = Battery()) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: one row per input row.

    Repeated rows each give a row; a null doc_id stays null; other columns are ignored; empty input gives an empty result.
    """
    found = scanned(docs.select("doc_id", "text"), b)
    number = lambda kind: F.size(F.filter("_spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(_written("_base").cast("binary"), 256).alias("base_sha256"), _written("_spans").alias("spans"), number(3).alias("n_random"),
    )


def redacted(docs: DataFrame, b: Battery = Battery(), mark: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch of its texts that spans cover replaced by ``mark``; a null text stays null.  Columns stay as they are."""
    found = scanned(docs, b)
    text, none = F.col("text"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    piece = lambda acc, x: F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
    done = F.aggregate("_spans", none, lambda acc, x: F.struct(F.greatest(acc["at"], x["end"]).alias("at"), piece(acc, x).alias("out")), lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return found.withColumn("text", F.when(F.size("_spans") > 0, done).otherwise(F.col("text"))).select(*docs.columns)
