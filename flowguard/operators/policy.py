"""Attack class → action, as a lookup in a small fixed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.constants import BENIGN, DEFAULT_ATTACK_ACTION, DENY_CLASSES, QUARANTINE_CLASSES
from flowguard.functions.labels import lookup_key
from flowguard.functions.numbers import as_col


def policy_table(
    spark: SparkSession,
    deny: list[str] | None = None,
    quarantine: list[str] | None = None,
) -> DataFrame:
    """``(class_name, class_key, action)``: one row per listed class, DENY first on overlap."""
    deny = DENY_CLASSES if deny is None else deny
    quarantine = QUARANTINE_CLASSES if quarantine is None else quarantine
    rows = [(c, "DENY") for c in deny] + [(c, "QUARANTINE") for c in quarantine if c not in deny]
    table = spark.createDataFrame(rows, "class_name string, action string")
    return table.select("class_name", lookup_key("class_name").alias("class_key"), "action")


def with_policy(
    df: DataFrame,
    binary: str,
    attack_type: str,
    policy: DataFrame | None = None,
    default: str = DEFAULT_ATTACK_ACTION,
) -> DataFrame:
    """Add ``policy_action`` and ``policy_reason``.

    The policy is a configured list (a handful of rows), hence the broadcast.
    """
    policy = policy_table(df.sparkSession) if policy is None else policy
    listed = F.broadcast(policy.select(F.col("class_key").alias("_key"), F.col("action").alias("_listed")))
    keyed = df.withColumn("_lookup", lookup_key(attack_type))
    joined = keyed.join(listed, keyed["_lookup"] == listed["_key"], "left")
    kind, listed_action = F.col(attack_type), F.col("_listed")
    # fixed values: wording of the reasons
    reason = (
        F.when(F.col(binary) == 0, F.lit("Traffic classified as benign."))
        .when(kind.isNull(), F.lit("Attack detected; attack type unavailable — applying default policy."))
        .when(listed_action == "DENY", F.concat(F.lit("High-risk attack type: "), kind))
        .when(
            listed_action == "QUARANTINE",
            F.concat(F.lit("Low-risk attack type: "), kind, F.lit(" — isolating for investigation.")),
        )
        .otherwise(
            F.concat(F.lit("Attack type '"), kind, F.lit(f"' not in policy lists — applying default: {default}."))
        )
    )
    action = F.when(F.col(binary) == 0, F.lit("ALLOW")).otherwise(F.coalesce(listed_action, F.lit(default)))
    return joined.select(*df.columns, action.alias("policy_action"), reason.alias("policy_reason"))


def expected_action(
    label: Column | str,
    deny: list[str] | None = None,
    quarantine: list[str] | None = None,
    default: str = DEFAULT_ATTACK_ACTION,
) -> Column:
    """Action a labelled flow should get: exact, case-sensitive list match."""
    label = as_col(label)
    deny = DENY_CLASSES if deny is None else deny
    quarantine = QUARANTINE_CLASSES if quarantine is None else quarantine
    return (
        F.when(label == BENIGN, F.lit("ALLOW"))
        .when(label.isin(deny), F.lit("DENY"))
        .when(label.isin(quarantine), F.lit("QUARANTINE"))
        .otherwise(F.lit(default))
    )


def policy_coverage(classes: DataFrame, class_col: str, policy: DataFrame | None = None) -> DataFrame:
    """Per action: classes listed for it, model classes that match it, and the size-based remainder."""
    spark = classes.sparkSession
    policy = policy_table(spark) if policy is None else policy
    known = classes.select(lookup_key(class_col).alias("class_key")).distinct()
    matched = (
        known.join(F.broadcast(policy), "class_key", "left")
        .groupBy(F.coalesce("action", F.lit("DEFAULT")).alias("action"))
        .agg(F.count("*").alias("matched"))
    )
    listed = policy.groupBy("action").agg(F.count("*").alias("listed"))
    domain = spark.createDataFrame([("DENY",), ("QUARANTINE",), ("DEFAULT",)], "action string")
    # one row each: list sizes and the number of model classes
    totals = known.agg(F.count("*").alias("n"))
    n_listed = policy.agg(F.count("*").alias("n"))
    remainder = F.greatest(F.lit(0).cast("bigint"), totals.scalar() - n_listed.scalar())
    return (
        domain.join(listed, "action", "left")
        .join(matched, "action", "left")
        .select(
            "action",
            F.when(F.col("action") == "DEFAULT", remainder)
            .otherwise(F.coalesce("listed", F.lit(0).cast("bigint")))
            .alias("listed"),
            F.coalesce("matched", F.lit(0).cast("bigint")).alias("matched"),
        )
    )


def layered_action(
    binary: Column | str,
    p_attack: Column | str,
    class_key: Column | str,
    class_confidence: Column | str,
    list_action: Column | str,
    rules: list[tuple[str, float, str]] = (("dos hulk", 0.6, "DENY"), ("portscan", 0.5, "QUARANTINE")),
    hard_block: float = 0.98,
) -> Column:
    """Three layers: near-certain attack, per-class confidence rule, then the list policy."""
    decided = F.when(as_col(binary) == 0, F.lit("ALLOW")).when(as_col(p_attack) > hard_block, F.lit("DENY"))
    for name, above, action in rules:
        hit = (as_col(class_key) == name) & (as_col(class_confidence) > above)
        decided = decided.when(hit, F.lit(action))
    return decided.otherwise(as_col(list_action))


def policy_strategy(policy: DataFrame) -> DataFrame:
    """One row: list sizes and what they say about the strategy."""
    deny, hold = F.count_if(F.col("action") == "DENY"), F.count_if(F.col("action") == "QUARANTINE")
    strategy = (
        F.when(deny < 2, F.lit("Limited high-risk coverage"))
        .when(hold > deny, F.lit("Conservative Strategy"))
        .otherwise(F.lit("Aggressive Blocking"))
    )
    return policy.agg(deny.alias("n_deny"), hold.alias("n_quarantine"), strategy.alias("strategy"))
