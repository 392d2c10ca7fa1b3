"""Column expressions shared by the operators.  All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AVERAGE_MONTH = 30.4167  # days; fixed value that normalises counts of months


def first_match(arms: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """Ordered classifier: the value of the first arm whose predicate holds, NULL predicates failing."""
    out = F.lit(otherwise)
    for predicate, value in reversed(arms):
        out = F.when(predicate, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


# The kinds of attempt in the order in which they are tried.  A row is (type, transaction, payment, amount, method,
# product group, processor, gateway's processor); "" asks nothing, a leading ! means any other value.
ATTEMPTS = [
    ("Monthly Initial", "auth", "order", "a < 12", "!paypal", "", "", ""),
    ("Annual Sub Sale", "auth", "order", "a > 12 and a < 37 and a <> 23", "!paypal", "", "", ""),
    ("Upgrades", "auth", "order", "a = 39", "!paypal", "", "", ""),
    ("Addon Sale", "capture", "order", "", "!paypal", "2", "", ""),
    ("Monthly Initial", "captureauth", "order", "a < 12", "paypal", "", "paypal", ""),
    ("Monthly Initial", "auth", "order", "a < 12", "paypal", "", "processor_a", ""),
    ("Monthly Initial", "capture", "order", "a < 12", "paypal", "1", "", ""),
    ("Annual Sub Sale", "captureauth", "order", "a > 12 and a < 37", "paypal", "!2", "paypal", ""),
    ("Annual Sub Sale", "auth", "order", "a > 12 and a < 37", "paypal", "!2", "processor_a", ""),
    ("Annual Sub Sale", "capture", "order", "a > 11", "paypal", "1", "", ""),
    ("Upgrades", "captureauth", "order", "a = 39", "paypal", "", "paypal", ""),
    ("Upgrades", "auth", "order", "a = 39", "paypal", "", "processor_a", ""),
    ("Addon Sale", "captureauth", "order", "", "paypal", "2", "", ""),
    ("Monthly Renewal", "capture", "invoice", "a < 19", "", "!2", "", ""),
    ("Annual Sub Renewal", "capture", "invoice", "a > 18 and a <> 49", "", "!2", "", ""),
    ("Annual Sub Renewal", "capture", "invoice", "a = 49", "", "!2", "", "processor_b"),
    ("P6M Renewals", "capture", "invoice", "a = 49 or a = 80", "", "!2", "", "!processor_b"),
    ("Addon Renewal", "capture", "invoice", "", "", "2", "", ""),
    ("Refund", "refund", "", "", "", "", "", ""),
    ("Monthly Renewal", "auth", "invoice", "a < 19", "", "!2", "", ""),
    ("Annual Sub Renewal", "auth", "invoice", "a > 18", "", "!2", "", ""),
    ("Addon Renewal", "auth", "invoice", "", "", "2", "", ""),
    ("Bin", "captureauth", "", "", "creditcard,debitcard,prepaidcard,google_pay,apple_pay", "", "", ""),
    ("Bin", "auth", "", "", "paypal", "", "", ""),
]


def attempt_type(rows: DataFrame, columns: Sequence[str] = ("transaction", "payment", "amount", "method", "product_group", "processor", "gateway_processor"), out: str = "rpgt") -> DataFrame:
    """``rows`` with the type of each attempt by the first of ``ATTEMPTS`` that fits; NULL fits nothing that is asked; amounts between the bands are ``Error``."""
    arms = []
    for kind, *asked in ATTEMPTS:
        fits = F.lit(True)
        for name, want in zip(columns, asked, strict=True):
            value = F.col(name)
            if want.startswith("a "):
                fits = fits & F.expr("(" + want.replace("a ", f"`{name}` ") + ")")
            elif want.startswith("!"):
                fits = fits & (value != want[1:])
            elif want:
                fits = fits & value.isin(*want.split(","))
        arms.append((fits, kind))
    return rows.withColumn(out, first_match(arms, "Error"))


def attempt_flags(rows: DataFrame) -> DataFrame:
    """Columns initial_attempt, initial_success and initial_failure: first payments, of cards at the first attempt, of wallet accounts before the third.  Columns method, success, fcp, attempt, attempt_number."""
    first = F.when(F.col("method") != "paypal", (F.col("fcp") == 1) & (F.col("attempt") == 1)).when(F.col("method") == "paypal", (F.col("fcp") == 1) & (F.col("attempt_number") < 3))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return rows.withColumns({"initial_attempt": flag(first), "initial_success": flag(first & F.col("success")), "initial_failure": flag(first & ~F.col("success"))})


def record_type(rebill: Column, term: Column, action: Column, group: Column, record: Column, refunds: bool = True) -> Column:
    """Transaction type of a risk record; the macro variant leaves the refund arm out."""
    arms = [
        ((rebill == 0) & term.isin("P1M", "P30D"), "monthly initial"),
        ((rebill == 0) & term.isin("P1Y", "P12M"), "annual initial"),
        ((rebill == 1) & term.isin("P1M", "P30D"), "monthly first renewal"),
        ((rebill > 1) & term.isin("P1M", "P30D"), "monthly renewal"),
        ((rebill > 0) & term.isin("P1Y", "P12M"), "annual renewal"),
        ((action == "upgrade") & (group != "addon"), "upgrade"),
        (group == "addon", "addon"),
    ]
    return first_match(arms + ([(F.lower(record) == "refund", "refund")] if refunds else []), "Other")


def account_type(value: Column) -> Column:
    """Roll-up of card schemes; NULL and unknown fall together.  ``_`` in a LIKE pattern stands for any character."""
    v = F.lower(value)
    return first_match(
        [
            (v.isNull() | v.like("%unknown%"), "unknown"),
            (v.like("%maestro%") | v.like("%master_card%"), "mastercard"),
            (v.like("%american%") & v.like("%express%"), "amex"),
        ],
        v,
    )


def provider_listed(provider: Column, wallets: Sequence[str]) -> Column:
    """Provider bucket by list: NULL stays NULL."""
    return F.when(~provider.isin(*wallets), F.lit("non_wallet")).otherwise(provider)


def provider_like(provider: Column, patterns: Mapping[str, str]) -> Column:
    """Provider bucket by pattern: NULL is ``non_wallet``."""
    return first_match([(F.upper(provider).like(p), name) for p, name in patterns.items()], "non_wallet")


def first_payment_flag(value: Column) -> Column:
    """``2+`` where the count differs from 1, else ``1``; NULL is ``1``."""
    return F.when(value != 1, F.lit("2+")).otherwise(F.lit("1"))


def country_flag(value: Column) -> Column:
    return F.when(F.upper(value).isin("US", "USA"), F.lit("USA")).otherwise(F.lit("Non-USA"))


def month_diff(later: Column, earlier: Column) -> Column:
    """Calendar month boundaries between two dates, negative backwards."""
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("int")


def clean_key(value: Column) -> Column:
    """Lower-cased, trimmed key without a float's trailing ``.0``."""
    return F.regexp_replace(F.lower(F.trim(value.cast("string"))), r"\.0$", "")


def canonical_gateway(value: Column) -> Column:
    """Gateway name without its deprecated ``-x`` ending."""
    return F.regexp_replace(value, "-x$", "")


def composite_key(columns: Sequence[Column], missing: Sequence[str] | None = None) -> Column:
    """Cleaned columns joined by ``|``; a missing part is ``unknown`` or its own default."""
    missing = missing or ["unknown"] * len(columns)
    return F.concat_ws("|", *[F.coalesce(clean_key(c), F.lit(m)) for c, m in zip(columns, missing, strict=True)])


def percent(value: Column) -> Column:
    """Number from text with an optional percent sign; unreadable text is NULL."""
    return F.expr("1D") * F.replace(value.cast("string"), F.lit("%"), F.lit("")).try_cast("double")


def finite(value: Column) -> Column:
    """NULL, NaN and infinities become 0."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def share_of(value: str, keys: Sequence[str], on_zero: str = "zero") -> Column:
    """Value over its total within ``keys``.  A total of zero gives 0, keeps the value, or spreads evenly (``zero``, ``keep``, ``even``)."""
    w = Window.partitionBy(*keys)
    total = F.sum(value).over(w)
    fallback = {"zero": F.lit(0.0), "keep": F.col(value).cast("double"), "even": F.lit(1.0) / F.count(F.lit(1)).over(w)}[on_zero]
    return F.when(total > 0, F.col(value) / total).otherwise(fallback)


def month_factor(latest: Column) -> Column:
    """Scale of a partly seen month: an average month over the day of the month's end."""
    return F.lit(AVERAGE_MONTH) / F.dayofmonth(F.last_day(latest))


def first_present(frame: DataFrame, names: Sequence[str]) -> str:
    """The first of ``names`` that the frame has."""
    for n in names:
        if n in frame.columns:
            return n
    raise ValueError(f"none of {list(names)} in {frame.columns}")


def normalise_columns(frame: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename by alias lists.  Several columns with one target are coalesced in list order, so no name occurs twice."""
    lower = {c.lower().strip(): c for c in frame.columns}
    taken: dict[str, list[str]] = {}
    for target, names in aliases.items():
        found = [lower[n.lower()] for n in dict.fromkeys([target, *names]) if n.lower() in lower]
        if found:
            taken[target] = found
    used = {c for found in taken.values() for c in found}
    renamed = [(F.coalesce(*[F.col(f"`{c}`") for c in found]) if len(found) > 1 else F.col(f"`{found[0]}`")).alias(t) for t, found in taken.items()]
    return frame.select(*[F.col(f"`{c}`") for c in frame.columns if c not in used], *renamed)


def card_scheme(card: Column, account: Column) -> Column:
    """Scheme of a card by the first network name in its type, else its account type."""
    # Name in the card's type, scheme, in this order.
    names = [("nyce", "nyce"), ("pulse", "pulse"), ("accel", "accel"), ("star", "star"), ("mc_google_pay", "mastercard"), ("mc_applepay", "mastercard"), ("maestro_usa", "mastercard"), ("mastercard", "mastercard"), ("maestro", "mastercard"), ("visa", "visa")]
    return first_match([(card.contains(n), scheme) for n, scheme in names], account)


def sticky_flag(renewal: Column, company: Column, exempt: str) -> Column:
    """``sticky`` for the first three renewals of any company but ``exempt``; anything else, NULL included, is ``non_sticky``."""
    return F.when((company != exempt) & renewal.cast("string").isin("1", "2", "3"), F.lit("sticky")).otherwise(F.lit("non_sticky"))


def poly_key(default: Sequence[str], groups: Mapping[str, Mapping[str, Sequence[str]]], levels: Mapping[str, Sequence[str]], kind: Column, bin_: Column) -> Column:
    """Default key, or for a BIN in one of its type's groups the type's level key with the group's name.

    ``groups``: type -> group -> BINs; ``levels``: type -> columns.  Both are short settings.
    """
    key = lambda columns: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in columns])
    arms = [((kind == k) & clean_key(bin_).isin(*[str(b).lower() for b in bins]), F.concat_ws("|", key(levels.get(k, default)), F.lit(g))) for k, some in groups.items() for g, bins in some.items()]
    return first_match(arms, key(default)) if arms else key(default)


def zeroed(value: Column, bin_: Column, prefix: str) -> Column:
    """0 where the BIN starts with ``prefix``, else the value."""
    return F.when(bin_.cast("string").startswith(prefix), F.lit(0).cast("double")).otherwise(value.cast("double"))


def any_positive(*values: Column) -> Column:
    """True where some value is above 0; NULL counts as 0."""
    return F.greatest(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values], F.lit(0.0)) > 0


def mapped(value: Column, names: Mapping[str, str]) -> Column:
    """Value by a short list of names, without regard to case; others stay."""
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k.lower(), v)])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(value))), value)


def switched_off(overrides: Mapping[str, Mapping[str, object]], scope: Sequence[str] = ("trx", "both")) -> list[str]:
    """Canonical names of the gateways whose target is 0 within ``scope``."""
    names = {str(g).strip().lower().removesuffix("-x") for g, o in overrides.items() if isinstance(o, Mapping) and str(o.get("target", "")).strip() in ("0", "0.0") and str(o.get("apply_to", "")).strip().lower() in scope}
    return sorted(names)


def gateway_columns(columns: Sequence[str], keys: Sequence[str]) -> list[str]:
    """Columns of a wide template that hold gateways' shares: those that are not keys, by name without regard to case."""
    taken = {k.lower() for k in keys}
    return [c for c in columns if c.lower() not in taken and not c.startswith("_")]


def scheme_code(scheme: Column) -> Column:
    """``vi`` for the first scheme (and where none is named), ``non-vi`` for all others."""
    return F.when(F.lower(F.trim(F.coalesce(scheme, F.lit("visa")))) == "visa", "vi").otherwise("non-vi")
