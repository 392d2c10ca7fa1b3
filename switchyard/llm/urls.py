"""URL filtering by a character language-model ratio, on DataFrame functions alone.

Method: rules decide some URLs.  From those, a smoothed variable-order Markov model of characters is learnt for accepted
and for rejected URLs; each order backs off to the next shorter context.  Any other URL is judged by the difference of
its log-likelihoods divided by its length, against a threshold calibrated on ruled URLs held out from training.

Scale: n-gram counts are pre-aggregated before each shuffle.  The model is a table of all n-grams and grows with the data;
it is joined to the distinct longest n-grams of all URLs, and those to the URLs.  Only the n-grams that each hold a fixed
share of all places are broadcast, of which there can be but so many; no other is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchyard.llm.scratch import stored

# Fixed values: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
PAD, UNIT = "\x02", 1e9


@dataclass(frozen=True)
class Ratio:
    """``order``: longest n-gram; ``weight``: strength of the shorter context; an n-gram that holds one ``hot``-th of all places is broadcast; one ``fold``-th of the ruled URLs calibrates; ``step``: width of a threshold bin."""

    order: int = 5
    weight: float = 4.0
    hot: int = 10_000
    fold: int = 5
    step: float = 0.02


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def located(pages: DataFrame) -> DataFrame:
    """page_id, rest (what follows ``://``), host, path, rule, ruled (the rule's verdict)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    out = pages.select(F.col("page_id"), F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit("")).alias("rest"))
    raw = F.regexp_extract("rest", "^[^/?#]*", 0)
    out = out.select("page_id", "rest", _lower(raw).alias("host"), F.regexp_extract(F.substr("rest", F.length(raw) + 1), "^[^?#]*", 0).alias("path"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return out.withColumn("rule", rule).withColumn("ruled", ruled)


def _gram(chars: str, at: Column, size: int) -> Column:
    return F.array_join(F.slice(chars, at, F.lit(size)), "")


def model(train: DataFrame, p: Ratio) -> list[DataFrame]:
    """For each order from 1 on, the log ratio accepted / rejected of its n-grams (g, ratio).

    P_k(c | context) = (n(context c) + weight * P_(k-1)(c | shorter context)) / (n(context) + weight), from a uniform P_0.
    """
    n = p.order
    grams = train.select("ruled", F.explode(F.transform(F.sequence(F.lit(1), F.size("chars") - n + 1), lambda i: _gram("chars", i, n))).alias("g"))
    classes = {"allow": "x", "block": "y"}
    grams = stored(grams.groupBy("g").agg(*[F.sum((F.col("ruled") == v).cast("long")).alias(c) for v, c in classes.items()]), "ngrams")
    below, levels = None, []
    for k in range(1, n + 1):
        level = grams.groupBy(F.substring("g", n - k + 1, k).alias("g")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        contexts = level.groupBy(F.substring("g", 1, k - 1).alias("context")).agg(F.sum("x").alias("cx"), F.sum("y").alias("cy"))
        level = level.withColumn("context", F.substring("g", 1, k - 1)).join(contexts, "context")
        if below is None:
            level = level.withColumn("px", F.lit(1 / 256)).withColumn("py", F.lit(1 / 256))
        else:
            level = level.withColumn("shorter", F.substring("g", 2, k - 1)).join(below, "shorter")
        chance = lambda c: ((F.col(c) + p.weight * F.col("p" + c)) / (F.col("c" + c) + p.weight)).alias("q" + c)
        level = stored(level.select("g", "x", "y", chance("x"), chance("y")), f"order{k}")
        levels.append(level.select("g", F.log(F.col("qx") / F.col("qy")).alias("ratio")))
        below = level.select(F.col("g").alias("shorter"), F.col("qx").alias("px"), F.col("qy").alias("py"))
    return levels


def summed(rows: DataFrame, levels: list[DataFrame], p: Ratio) -> DataFrame:
    """``rows`` (u, chars) -> u, total: the ratios of all places added up, each from the longest known n-gram that ends there.

    Ratios are whole multiples of 1 / ``UNIT``, so that the order of adding does not matter.
    """
    n = p.order
    each = rows.where(F.size("chars") >= n).select("u", F.explode(F.transform(F.sequence(F.lit(1), F.size("chars") - n + 1), lambda i: _gram("chars", i, n))).alias("g"))
    known = each.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    for k in range(n, 0, -1):
        level = levels[k - 1].select(F.col("g").alias("end"), F.col("ratio").alias(f"ratio{k}"))
        known = known.withColumn("end", F.substring("g", n - k + 1, k)).join(level, "end", "left").drop("end")
    ratio = F.coalesce(*[F.col(f"ratio{k}") for k in range(n, 0, -1)], F.lit(0.0))
    known = stored(known.select("g", "n", F.round(ratio * UNIT).cast("long").alias("ratio")), "known")
    places = known.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    hot = F.broadcast(known.where(F.col("n") * p.hot >= places).select("g", "ratio"))  # at most ``hot`` rows
    cold = known.where(F.col("n") * p.hot < places).select("g", "ratio")
    parts = each.join(hot, "g").unionByName(each.join(hot, "g", "left_anti").join(cold, "g"))
    return parts.groupBy("u").agg((F.sum("ratio") / UNIT).alias("total"))


def url_verdicts(pages: DataFrame, p: Ratio = Ratio()) -> DataFrame:
    """``pages`` (page_id, url, ...) -> page_id, host, path, rule, verdict, score: one row per input row.

    ``score`` is the length-normalised log-likelihood difference, per character; a URL without ``://``, or null, has empty
    parts and score 0.  A rule's verdict stands; else the score decides at the calibrated threshold (0 where no ruled URL
    is held out).  Repeated rows each give a row; other columns are ignored; empty input gives an empty result.
    """
    rows = located(pages).withColumn("held", F.pmod(F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), F.lit(p.fold)) == 0)
    padded = F.concat(F.lit(PAD * (p.order - 1)), _lower(F.col("rest")))
    rows = stored(rows.withColumn("chars", F.split(padded, "")).withColumn("u", F.monotonically_increasing_id()), "urls")
    fitted = model(rows.where("ruled is not null and not held"), p)

    n = F.size("chars") - (p.order - 1)
    scored = rows.join(summed(rows.select("u", "chars"), fitted, p), "u", "left")
    scored = scored.select("page_id", "host", "path", "rule", "ruled", "held", F.when(n > 0, F.col("total") / n).otherwise(0.0).alias("score"))
    scored = stored(scored, "scores")

    # of all bins of the held-out scores, the one from which acceptance has the best balanced accuracy; the cut is half-way to the bin below
    bins = scored.where("held and ruled is not null").groupBy(F.floor(F.col("score") / p.step).alias("bin")).agg(F.sum((F.col("ruled") == "allow").cast("long")).alias("x"), F.sum((F.col("ruled") == "block").cast("long")).alias("y"))
    bins = bins.where(F.abs("bin") <= 5000)
    up = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)  # at most 10001 rows
    down = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    share = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)) / F.greatest(F.sum(c).over(whole), F.lit(1))
    below = F.coalesce(F.lag("bin").over(Window.orderBy("bin")), F.col("bin") - 1)
    judged = bins.select(((F.col("bin") + below + 1) / 2 * p.step).alias("cut"), (share("x", up) + share("y", down)).alias("accuracy"))
    cut = judged.agg(F.coalesce(F.max_by("cut", F.struct(F.round("accuracy", 6), -F.abs("cut"))), F.lit(0.0)).alias("cut")).scalar()
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"), "score")
