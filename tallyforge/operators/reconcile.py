"""Reported values against facts: periods, comparison, severity, range joins, accuracy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import percentage_difference, scale_match, within_tolerance
from .mapping import with_all
from .quantiles import with_quantile

# Key concepts, and words of relevant concepts.
KEY_CONCEPTS = (
    "Revenues", "Revenue", "SalesRevenueNet", "NetIncomeLoss", "NetIncome", "ProfitLoss", "Assets", "TotalAssets", "AssetsCurrent", "Liabilities", "LiabilitiesAndStockholdersEquity", "StockholdersEquity", "ShareholdersEquity",
    "CashAndCashEquivalentsAtCarryingValue", "OperatingIncomeLoss", "GrossProfit", "CostOfRevenue", "CostOfGoodsAndServicesSold", "ResearchAndDevelopmentExpense", "SellingGeneralAndAdministrativeExpenses", "PropertyPlantAndEquipmentNet",
    "Goodwill", "IntangibleAssetsNetExcludingGoodwill",
)
RELEVANT = ("revenue", "income", "profit", "loss", "asset", "liability", "equity", "cash", "expense", "cost", "sales", "earnings", "balance", "debt", "capital", "investment", "dividend")


def relevant(concept, exact: list[str] | None = None, parts=KEY_CONCEPTS + RELEVANT):
    """F1 with ``exact``; else F2: a key concept or a relevant word stands in the name, in any case."""
    return concept.isin(*exact) if exact else F.coalesce(F.lower(concept).rlike("|".join(p.lower() for p in parts)), F.lit(False))


def first_facts(facts: DataFrame, seq: str) -> DataFrame:
    """Facts without a segment, the first of each (concept, context, value)."""
    w = W.partitionBy("concept", "context_id", "numeric_value").orderBy(seq)
    return facts.where("segment IS NULL").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest_period(facts: DataFrame, key: str = "concept") -> DataFrame:
    """Of each key the rows of the latest end date; without end dates those of the latest instant; without both all."""
    last = facts.groupBy(F.col(key).alias("_key")).agg(F.max("end_date").alias("_e"), F.max("instant_date").alias("_i"))
    df = facts.join(last, facts[key].eqNullSafe(last["_key"]))  # summed before the shuffle: a key may hold a third of all rows
    keep = F.when(F.col("_e").isNotNull(), F.col("end_date") == F.col("_e")).when(F.col("_i").isNotNull(), F.col("instant_date") == F.col("_i")).otherwise(True)
    return df.where(F.coalesce(keep, F.lit(False))).drop("_e", "_i", "_key")


def aggregate_values(df: DataFrame, keys: list[str], value: str, how: str = "sum", seq: str | None = None) -> DataFrame:
    """A2: sum, mean, or latest (the last row by ``seq``); anything else sums."""
    agg = {"mean": F.avg(value), "latest": F.max_by(value, seq or value)}.get(how, F.sum(value))
    return df.groupBy(*keys).agg(agg.alias("value"))


def concept_summary(facts: DataFrame, key: str, value: str, modes: list[str]) -> DataFrame:
    """A1: count, sum, mean, min, max, and the most frequent value of ``modes`` (ties: the smallest)."""
    base = facts.groupBy(key).agg(F.count(value).alias("n"), F.round(F.sum(value), 2).alias("sum"), F.round(F.avg(value), 2).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    for m in modes:
        top = facts.where(F.col(m).isNotNull()).groupBy(key, m).agg(F.count("*").alias("k")).groupBy(key).agg(F.min_by(m, F.struct(-F.col("k"), F.col(m))).alias(f"{m}_mode"))
        base = base.join(top, key, "left")
    return base


def resolve_column(labels: DataFrame, columns: DataFrame) -> DataFrame:
    """The column of each label: the equal one if it holds a number, else the first by col_idx with mutual containment if that holds one.

    columns(column, col_idx): headers of one table; with ``numeric``, whether the column holds a number (without it all do).
    """
    own = labels.select("label").distinct()
    number = F.col("numeric") if "numeric" in columns.columns else F.lit(True)
    met = with_all(own, columns.select("column", "col_idx", number.alias("numeric")).distinct()).where(F.lower("column").contains(F.lower("label")) | F.lower("label").contains(F.lower("column")))
    found = own.join(met, "label", "left").groupBy("label").agg(F.min(F.when((F.col("column") == F.col("label")) & F.col("numeric"), F.struct("col_idx", "column"))).alias("e"), F.min(F.struct("col_idx", "column", "numeric")).alias("s"))
    return found.select("label", F.coalesce("e.column", F.when(F.col("s.numeric"), F.col("s.column"))).alias("column"))


def reconcile(mapping: DataFrame, reported: DataFrame, facts: DataFrame, ignore_unmapped: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """mapping(label, concept), reported(label, pdf_value), facts(concept, fact_value) to discrepancies only. All have the columns ``by``, which must agree too."""
    df = mapping.join(reported, [*by, "label"], "left").join(facts, [*by, "concept"], "left")
    if ignore_unmapped:
        df = df.where("concept IS NOT NULL")
    p, x = F.col("pdf_value"), F.col("fact_value")
    df = df.withColumn("scale", scale_match(p, x))
    kind = (
        F.when(F.col("concept").isNull(), "no_xbrl_mapping").when(p.isNull() & x.isNull(), None).when(p.isNull(), "missing_pdf_value").when(x.isNull(), "missing_xbrl_value")
        .when(within_tolerance(p, x), None).when(F.col("scale").isNotNull(), "scale_mismatch").otherwise("value_mismatch")
    )
    df = df.withColumn("discrepancy_type", kind).where("discrepancy_type IS NOT NULL")
    both = p.isNotNull() & x.isNotNull()
    return df.select(
        *by, "label", "concept", "pdf_value", "fact_value", F.abs(p - x).alias("difference"), F.when(both, percentage_difference(p, x)).alias("percentage_difference"),
        F.col("scale").isNotNull().alias("scaled_match"), F.col("scale.factor").alias("scale_factor"), F.col("scale.direction").alias("scale_direction"), "discrepancy_type",
    ).withColumn("severity", severity(F.col("discrepancy_type"), F.col("percentage_difference")))


def severity(kind, percent):
    """M11."""
    return F.when(kind == "no_xbrl_mapping", "unmapped").when(kind.startswith("missing"), "missing_data").when(kind == "error", "errors").when(kind == "scale_mismatch", "moderate").when(percent > 10, "critical").when(percent > 1, "moderate").otherwise("minor")


def severity_counts(found: DataFrame, exact: bool = True) -> DataFrame:
    """A3, A4: counts by the six severities and ``data_issues`` (missing and unmapped together), and statistics of finite percentages (a missing one counts as 0).

    The exact median is that of ``quantiles.quantile``; without ``exact`` it is a sketch's.
    """
    n = lambda s: F.sum(F.when(F.col("severity").isin(*s), 1).otherwise(0))
    pct = F.coalesce("percentage_difference", F.lit(0.0))
    pct = F.when(pct < math.inf, pct)
    counts = found.agg(F.count("*").alias("n"), n(["critical"]).alias("critical"), n(["moderate"]).alias("moderate"), n(["minor"]).alias("minor"), n(["missing_data"]).alias("missing_data"), n(["unmapped"]).alias("unmapped"), n(["missing_data", "unmapped"]).alias("data_issues"), n(["errors"]).alias("errors"), F.avg(pct).alias("mean_pct"), F.max(pct).alias("max_pct"), F.min(pct).alias("min_pct"), *([] if exact else [F.percentile_approx(pct, 0.5, 100_000).alias("median_pct")]))
    return with_quantile(counts, found.select(pct.alias("_pct")), [], "_pct", 0.5, "median_pct") if exact else counts


def value_range_join(left: DataFrame, right: DataFrame, tolerance: float = 0.1, key: str = "id", value: str = "value", heavy: int = 100_000, pairs: int = 20_000_000) -> DataFrame:
    """Pairs whose values differ by at most ``tolerance`` of the larger, as an equi-join on logarithmic buckets.

    A bucket is as wide as the tolerance, so partners lie in the same or a neighbouring one: the right side is given
    three buckets. Signs must agree; zeros meet zeros. A bucket with more than ``heavy`` rows of the left side, and more than a ten-thousandth
    of all, is split: its left rows are dealt over several tasks, and right rows go to each of them. A frequent value is
    merged on both sides before the join if keys are not wanted (see ``range_partners``).
    """
    width = math.log(1 / (1 - tolerance))
    bucket = F.when(F.col("v") == 0, F.lit(0).cast("long")).otherwise(F.floor(F.log(F.abs("v")) / width).cast("long"))
    a = left.select(F.col(key).alias("left_id"), F.col(value).alias("v")).where("v IS NOT NULL").select("left_id", F.col("v").alias("left_value"), F.signum("v").alias("s"), bucket.alias("b"))
    b = right.select(F.col(key).alias("right_id"), F.col(value).alias("v")).where("v IS NOT NULL").select("right_id", F.col("v").alias("right_value"), F.signum("v").alias("s"), bucket.alias("b0")).select("*", F.explode(F.sequence(F.col("b0") - 1, F.col("b0") + 1)).alias("b")).drop("b0")
    larger = F.greatest(F.abs("left_value"), F.abs("right_value"))
    counts = a.groupBy("s", "b").agg(F.count("*").alias("n"))
    sizes = counts.join(b.groupBy("s", "b").agg(F.count("*").alias("m")), ["s", "b"], "left").withColumn("k", F.col("n") * F.coalesce("m", F.lit(0)))
    rows, met = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    limit, most = max(heavy, -(-rows // 10_000)), max(pairs, -(-met // 10_000))
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-met // pairs))
    large = F.broadcast(sizes.where((F.col("n") > limit) | (F.col("k") > most)).select("s", "b", F.greatest(F.ceil(F.col("n") / limit), F.ceil(F.col("k") / most)).alias("parts")))  # under 20,000 rows
    parts = F.coalesce("parts", F.lit(1))
    a = a.join(large, ["s", "b"], "left").withColumn("part", F.pmod(F.xxhash64("left_id"), parts)).drop("parts")
    b = b.join(large, ["s", "b"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    a, b = (x.repartition(tasks, "s", "b", "part") for x in (a, b))
    found = a.join(b, ["s", "b", "part"]).where(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance * larger)
    return found.select("left_id", "right_id", "left_value", "right_value", F.when(F.col("left_value") == F.col("right_value"), "Exact").otherwise("Close").alias("quality"))


def range_partners(left: DataFrame, right: DataFrame, tolerance: float = 0.1, key: str = "id", value: str = "value") -> DataFrame:
    """Per left row the number of partners within ``tolerance``, without listing them: equal values are merged on both sides first."""
    def merged(df):
        return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")).withColumn("id", F.col("value"))

    pairs = value_range_join(merged(left), merged(right), tolerance).join(merged(right).select(F.col("value").alias("right_value"), "n"), "right_value")
    counts = pairs.groupBy("left_value").agg(F.sum("n").alias("partners"))
    return left.join(counts, left[value] == counts["left_value"], "left").select(F.col(key), F.col(value), F.coalesce("partners", F.lit(0)).alias("partners"))


def nearest_values(truth: DataFrame, parsed: DataFrame, key: str = "key", parts: int | None = None) -> DataFrame:
    """(key, truth, below, above, least): for each distinct truth (key, truth) the nearest parsed values (key, value) on both sides, and the key's least.

    Truths and values are sorted together, and a truth takes the last value before it and the first behind it: no pairs of them are made.
    A key's numbers are dealt by magnitude (a bucket spans a twelfth part of it), so that a frequent key is sorted in many
    tasks, ``parts`` of them if given; only the ends of buckets, some thousands a key at most, are ranked by key.
    """
    dealt = lambda df, *cols: df.repartition(parts, *cols) if parts else df
    size = F.floor(F.log2(F.abs("p")) * 8) + 10_000
    u = truth.select(key, F.col("truth").cast("double").alias("p"), F.lit(1).alias("side")).unionByName(parsed.where(F.col("value").isNotNull()).select(key, F.col("value").cast("double").alias("p"), F.lit(0).alias("side")))
    u = u.withColumn("_b", F.when(F.col("p") == 0, F.lit(0)).when(F.col("p") > 0, size).otherwise(-size))
    u = dealt(u, key, "_b").distinct().withColumn("v", F.when(F.col("side") == 0, F.col("p")))
    by_key = W.partitionBy(key).orderBy("_b")
    ends = dealt(u.groupBy(key, "_b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("side").alias("_asked")), key)
    ends = ends.select(
        key, "_b", F.last("hi", True).over(by_key.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.first("lo", True).over(by_key.rowsBetween(1, W.unboundedFollowing)).alias("_behind"), F.min("lo").over(W.partitionBy(key)).alias("least"), "_asked",
    ).where("_asked = 1").drop("_asked")  # buckets without a truth are done with
    inside = W.partitionBy(key, "_b").orderBy("p", "side")
    u = u.withColumns({"_lo": F.last("v", True).over(inside.rowsBetween(W.unboundedPreceding, 0)), "_hi": F.first("v", True).over(inside.rowsBetween(0, W.unboundedFollowing))}).where("side = 1")
    e = ends.withColumnRenamed(key, "_k")
    met = u.join(e.withColumnRenamed("_b", "_eb"), u[key].eqNullSafe(F.col("_k")) & u["_b"].eqNullSafe(F.col("_eb")))
    return met.select(key, F.col("p").alias("truth"), F.coalesce("_lo", "_before").alias("below"), F.coalesce("_hi", "_behind").alias("above"), "least")


def best_match(truth: DataFrame, parsed: DataFrame, key: str = "key", parts: int | None = None) -> DataFrame:
    """Per truth (key, truth) the most accurate parsed value (key, value) and its class; ties go to the smaller value."""
    acc = lambda v: F.when(F.col("truth") == 0, (v == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(v - F.col("truth")) / F.abs("truth")))
    option = lambda c: F.when(F.col(c).isNotNull(), F.struct(acc(F.col(c)).alias("accuracy"), (-F.col(c)).alias("minus")))
    near = nearest_values(truth, parsed, key, parts)
    best = F.array_max(F.filter(F.array(option("below"), option("above"), option("least")), lambda x: x.isNotNull() & x["accuracy"].isNotNull()))
    best = near.withColumn("b", best).select(key, "truth", (-F.col("b.minus")).alias("value"), F.round(F.coalesce("b.accuracy", F.lit(0.0)), 6).alias("accuracy"))
    return best.withColumn("match", F.when(F.col("accuracy") >= 0.9, "match").when(F.col("accuracy") >= 0.5, "near").otherwise("missing"))


def accuracy_rates(matches: DataFrame) -> DataFrame:
    """Rates over all truths, and a status."""
    rate = lambda m: F.avg(F.when(F.col("match") == m, 1.0).otherwise(0.0))
    r = matches.agg(F.count("*").alias("n"), rate("match").alias("match_rate"), rate("near").alias("near_rate"), rate("missing").alias("missing_rate"), F.avg(F.coalesce("accuracy", F.lit(0.0))).alias("avg_accuracy"))
    found = F.col("match_rate") + F.col("near_rate")
    return r.withColumn("status", F.when((F.col("avg_accuracy") >= 0.9) & (found >= 0.8), "excellent").when((F.col("avg_accuracy") >= 0.7) & (found >= 0.6), "good").when((F.col("avg_accuracy") >= 0.5) & (found >= 0.4), "needs_improvement").otherwise("poor"))


def uncategorised_large(facts: DataFrame, known: DataFrame, file_col: str, value: str, seq: str, least: float = 1000, n: int = 20) -> DataFrame:
    """The first ``n`` large values of each file that are not categorised already (the limit is the report's)."""
    rest = facts.where(F.abs(value) > least).join(known.select(value).distinct(), value, "left_anti")
    return rest.withColumn("_r", F.row_number().over(W.partitionBy(file_col).orderBy(seq))).where(F.col("_r") <= n).drop("_r")


def lookalikes(df: DataFrame, text: str, order: list, n: int = 20) -> DataFrame:
    """M21's sample: how many of the first ``n`` texts hold a capital O, a small l or a capital I, which stand for digits (the limit is the diagnosis's)."""
    return df.orderBy(*order).limit(n).agg(F.count_if(F.col(text).rlike("[OlI]")).alias("n_lookalike"))


def diagnose(n_left, n_right, n_matched, mean_left, mean_right, n_periods, mapping_rate, n_lookalike=None):
    """struct(match_rate, causes) from one-row aggregates; the means are those of magnitudes.

    match_rate: matches over the smaller side's count, 0 without matches. Causes: several periods, means that differ by more than half of the larger,
    under half of the labels mapped, more than three look-alikes.
    """
    top = F.greatest(mean_left, mean_right)
    n_lookalike = F.lit(0) if n_lookalike is None else n_lookalike
    causes = F.array(F.when(n_periods > 1, "several periods"), F.when((top > 0) & (F.abs(mean_left - mean_right) / top > 0.5), "scales differ"), F.when(mapping_rate < 0.5, "few labels map"), F.when(n_lookalike > 3, "look-alike characters"))
    rate = F.when(n_matched > 0, n_matched / F.least(n_left, n_right)).otherwise(0.0)
    return F.struct(rate.alias("match_rate"), F.filter(causes, lambda x: x.isNotNull()).alias("causes"))


# Categories of facts and what their concepts contain.
CATEGORIES = {
    "revenue": ("Revenue", "SalesRevenueNet", "Revenues", "TotalRevenues"),
    "net_income": ("NetIncomeLoss", "NetIncome", "ProfitLoss", "EarningsLossFromContinuingOperations"),
    "total_assets": ("Assets", "TotalAssets", "AssetsTotal"),
    "total_equity": ("StockholdersEquity", "Equity", "TotalEquity", "ShareholdersEquity"),
    "cash": ("Cash", "CashAndCashEquivalents", "CashAndShortTermInvestments"),
    "debt": ("Debt", "TotalDebt", "LongTermDebt"),
    "shares_outstanding": ("SharesOutstanding", "CommonStockSharesOutstanding"),
}


def categorise(facts: DataFrame, categories: dict[str, tuple[str, ...]] | None = None, concept: str = "concept") -> DataFrame:
    """``facts`` with ``category``, once for each category whose words the concept contains in any case. A fact is never doubled in one category."""
    hit = [F.when(F.coalesce(F.lower(concept).rlike("|".join(w.lower() for w in ws)), F.lit(False)), name) for name, ws in (CATEGORIES if categories is None else categories).items()]
    return facts.withColumn("category", F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())))


def best_fact(facts: DataFrame, keys: list[str], seq: str, value: str = "numeric_value", context: str = "context_id", unit: str = "unit") -> DataFrame:
    """Of each key the fact of the best score: 10 for a context, 5 for a unit, millions of value up to 50; the first wins."""
    given = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0)
    score = 10 * given(context) + 5 * given(unit) + F.least(F.abs(value) / 1e6, F.lit(50.0))
    ranked = facts.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(score.desc(), seq)))
    return ranked.where("_r = 1").drop("_r")


def category_tops(facts: DataFrame, seq: str, period: str, value: str = "numeric_value", n: int = 3) -> DataFrame:
    """the first ``n`` facts of each category in its latest period with a value (the limit is the report's)."""
    valued = facts.where(F.col(value).isNotNull())
    last = valued.groupBy("category").agg(F.max(period).alias("_p"))  # a row a category: few
    latest = valued.join(F.broadcast(last), "category").where(F.col(period) == F.col("_p")).drop("_p")
    return latest.withColumn("_r", F.row_number().over(W.partitionBy("category").orderBy(seq))).where(F.col("_r") <= n).drop("_r")


def distinct_concepts(facts: DataFrame) -> DataFrame:
    """A28."""
    return facts.select("concept").where("concept IS NOT NULL").distinct()


def fact_order() -> list:
    """O1, O2: the order of facts in a file: by concept, then period, nulls last."""
    return [F.asc_nulls_last(c) for c in ("concept", "end_date", "instant_date")]


def reorder(df: DataFrame, first: list[str]) -> DataFrame:
    """The named columns that there are, then the others as they stand."""
    front = [c for c in first if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in front + [c for c in df.columns if c not in front]])


# How good a match is, best first.
MATCH_RANK = ("Exact", "Close", "Approximate", "None")


def rank_matches(df: DataFrame, keys: list[str], quality: str = "quality", difference: str = "difference") -> DataFrame:
    """Matches of each key numbered by quality, then by difference."""
    rank = F.lit(len(MATCH_RANK))
    for i, name in reversed(list(enumerate(MATCH_RANK))):
        rank = F.when(F.col(quality) == name, i).otherwise(rank)
    return df.withColumn("match_rank", F.row_number().over(W.partitionBy(*keys).orderBy(rank, F.asc_nulls_last(difference))))


def head(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key, as shown in a report."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
