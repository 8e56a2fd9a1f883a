"""Category cascade: correction, then ordered rules, then Uncategorized."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import COVERAGE_WINDOW_DAYS, DEFAULT_TAXONOMY, Rule, Taxonomy
from ledgerloom.operators.patterns import with_first_rule
from ledgerloom.plans.shapes import with_accounts

# How a label came about.
PROVENANCE = ("dict", "manual", "regex")


def match_rules(name: Column, rules: list[Rule]) -> Column:
    """Category of the first rule found anywhere in the name, else null.

    The name is bound once, so however the optimizer moves this it is not worked out per rule, and
    any number of rules stays below the size limit of generated code.
    """
    if not rules:
        return F.lit(None).cast("string")

    def first_hit(bound: Column) -> Column:
        return F.coalesce(*[F.when(bound.rlike(rule.pattern), F.lit(rule.category)) for rule in rules])

    return F.get(F.transform(F.array(name), first_hit), F.lit(0))


def usable_labels(labels: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Labels that may be applied, one per merchant key.

    A category outside the taxonomy falls through to the rules. `Uncategorized` counts only when
    somebody chose it by hand. Unknown provenance reads as `dict`.
    """
    by = F.when(F.col("by").isin(*PROVENANCE), F.col("by")).otherwise("dict")
    allowed = F.col("category").isin(*taxonomy.categories) & (
        (F.col("category") != taxonomy.uncategorized) | (by == "manual")
    )
    return labels.filter(allowed).select(
        "merchant_key", F.col("category").alias("label_category"), by.alias("label_by"),
        F.col("confidence").alias("label_confidence"),
    )


def with_rule(merchants: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """Add `rule_category`. A list of rules becomes one expression, a table of them an indexed join."""
    if isinstance(rules, DataFrame):
        return with_first_rule(merchants, rules)
    return merchants.withColumn("rule_category", match_rules(F.col("merchant_key"), rules))


def categorize(merchants: DataFrame, labels: DataFrame | None, rules: list[Rule] | DataFrame,
               taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Category and provenance per merchant. Recomputed from scratch, so a relink is the same call.

    Rules run once per merchant key. `labels` holds one row per key (see `labels.latest_labels`).
    """
    if labels is None:
        nothing = F.lit(None).cast("string")
        joined = merchants.withColumns({
            "label_category": nothing, "label_by": nothing,
            "label_confidence": F.lit(None).cast("double"),
        })
    else:
        joined = merchants.join(usable_labels(labels, taxonomy), "merchant_key", "left")
    labelled = F.col("label_category").isNotNull()
    ruled = F.col("rule_category").isNotNull()
    return (
        with_rule(joined, rules)
        .select(
            *merchants.columns,
            F.coalesce("label_category", "rule_category", F.lit(taxonomy.uncategorized)).alias("category"),
            F.when(labelled, F.col("label_by")).when(ruled, "regex").alias("categorized_by"),
            F.when(labelled, F.col("label_confidence")).when(ruled, 1.0).alias("confidence"),
        )
    )


def cascade_stats(categorized_merchants: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """How many merchants each step settled."""
    tier = F.coalesce("categorized_by", F.lit("unresolved"))
    return categorized_merchants.groupBy(tier.alias("tier")).agg(F.count("*").alias("merchants"))


def categorized(ledger: DataFrame, merchants: DataFrame, overrides: DataFrame | None = None,
                taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """The ledger with its effective category: override, else merchant, else Uncategorized.

    `merchants` is a stored table in production, so Spark sees its file size and broadcasts it only
    below its own threshold; above it both sides are shuffled and a hot merchant is split by the
    adaptive skew join. Rows without a merchant get a key of their own that matches nothing, so
    they spread out instead of meeting in one partition.
    """
    spread = F.coalesce("merchant_key", F.concat(F.lit("\u0000"), F.col("id")))
    names = merchants.select(F.col("merchant_key").alias("_key"), F.col("category").alias("_merchant"))
    rows = ledger.withColumn("_key", spread).join(names, "_key", "left").drop("_key")
    chosen = [F.col("_merchant"), F.lit(taxonomy.uncategorized)]
    if overrides is not None:
        own = overrides.select(F.col("txn_id").alias("id"), F.col("category").alias("_override"))
        rows = rows.join(own, "id", "left")
        chosen.insert(0, F.col("_override"))
    return rows.withColumn("category", F.coalesce(*chosen)).drop("_merchant", "_override")


def bucket_of(category: Column, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> Column:
    """Money bucket of a category. The roll-up is a handful of literals, so it needs no join."""
    named = [F.when(category.isin(*members), bucket) for bucket, members in taxonomy.members.items()]
    return F.coalesce(*named, F.lit(taxonomy.default_bucket))


def with_bucket(categorized_ledger: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    return categorized_ledger.withColumn("bucket", bucket_of(F.col("category"), taxonomy))


def coverage(categorized_ledger: DataFrame, as_of: date, days: int = COVERAGE_WINDOW_DAYS,
             keys: list[str] = ("account_id",), until: date | None = None,
             taxonomy: Taxonomy = DEFAULT_TAXONOMY, accounts: DataFrame | None = None) -> DataFrame:
    """Share of recent rows, and of their absolute value, that carry a real category.

    Both are 100 where there is no row, also for those of `accounts` that have none.
    """
    rows = categorized_ledger.filter(F.col("booking_date") >= F.lit(as_of - timedelta(days=days)))
    if until is not None:
        rows = rows.filter(F.col("booking_date") <= F.lit(until))
    known = F.col("category") != taxonomy.uncategorized
    value = F.abs("amount_cents")
    totals = rows.groupBy(*keys).agg(
        F.count("*").alias("window_txns"),
        F.count_if(known).alias("_known"),
        F.coalesce(F.sum(value), F.lit(0)).alias("_value"),
        F.coalesce(F.sum(F.when(known, value)), F.lit(0)).alias("_known_value"),
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) == 0, 100.0).otherwise(F.try_divide(100.0 * F.col(part), F.col(whole)))

    return with_accounts(totals, accounts, keys).select(
        *keys, "window_txns",
        share("_known", "window_txns").alias("count_pct"),
        share("_known_value", "_value").alias("value_pct"),
    )


def resolve_category(name: Column, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> Column:
    """Category named by loosely typed text, else null."""
    typed = F.lower(F.trim(name))
    return F.coalesce(*[F.when(typed == c.lower(), c) for c in taxonomy.categories])


def resolve_bucket(name: Column, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> Column:
    """Bucket named by its key or display label, else null; a trailing dot is ignored."""
    typed = F.regexp_replace(F.lower(F.trim(name)), r"\.+$", "")
    spellings = [
        F.when(typed.isin(b.lower(), taxonomy.labels.get(b, b).lower().rstrip(".")), b)
        for b in taxonomy.buckets
    ]
    return F.coalesce(*spellings)


def resolve_names(requests: DataFrame, column: str = "name",
                  taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Add the category a request means or, where it names none, the bucket."""
    category = resolve_category(F.col(column), taxonomy)
    return requests.withColumns({
        "category": category,
        "bucket": F.when(category.isNull(), resolve_bucket(F.col(column), taxonomy)),
    })
