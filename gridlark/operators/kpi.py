"""Roll-ups, promotion gate, value scenarios, tool budgets and invariant alerts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridlark.functions.numeric import is_finite
from gridlark.operators.ordered import running_total

# Fixed values.
MAX_TOOL_CALLS = 8
MAX_TOOL_CHARACTERS = 12_000
MAX_TURNS = 6
TOOL_NAMES = ("lookup_product", "search_products", "purchase_history")
SKU_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
TARGET_DEFECT_RATE = 0.01
CONFIDENCE = 0.95


def run_rollup(results: DataFrame, by: Sequence[str] = ("mode",)) -> DataFrame:
    """Outcomes, events, verified chains, writes and writes on blocked paths per mode."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("audit_events").alias("audit_events"),
        F.bool_and("audit_verified").alias("all_verified"),
        F.sum("writes").alias("writes"),
        F.sum(F.when(F.col("blocked"), F.col("writes")).otherwise(0)).alias("blocked_writes"),
    )


def required_sample(rate: float = TARGET_DEFECT_RATE, confidence: float = CONFIDENCE) -> int:
    """Zero-defect sample size for a defect rate at a confidence."""
    if not (0 < rate < 1 and 0 < confidence < 1):
        raise ValueError("rate and confidence lie strictly between 0 and 1")
    return math.ceil(math.log(1 - confidence) / math.log(1 - rate))


def defect_bound(sample: Column, confidence: float = CONFIDENCE) -> Column:
    """One-sided upper bound on the defect rate after ``sample`` clean reviews."""
    return F.when(sample > 0, F.lit(1.0) - F.pow(F.lit(1 - confidence), F.lit(1.0) / sample))


def promotion_gate(
    reviews: DataFrame, by: Sequence[str], rate: float = TARGET_DEFECT_RATE, confidence: float = CONFIDENCE
) -> DataFrame:
    """Reviewed items, defects, needed sample, bound at zero defects and the verdict."""
    out = reviews.groupBy(*by).agg(
        F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("defect")).alias("defects")
    )
    needed = required_sample(rate, confidence)
    clean = F.col("defects") == 0
    return out.withColumns(
        {
            "required": F.lit(needed).cast("bigint"),
            "upper_bound": F.when(clean, defect_bound(F.col("reviewed"), confidence)),
            "promoted": clean & (F.col("reviewed") >= needed),
        }
    )


_SHARES = ("auto_share", "escalation_share", "blocked_share", "current_rework_share")
REQUIRED_INPUTS = (
    "annual_volume", "current_minutes", "labor_cost_per_hour", "auto_share", "escalation_share", "blocked_share",
    "escalation_minutes", "security_minutes", "screening_cost", "extraction_cost", "infrastructure_cost",
    "fixed_annual_cost", "one_time_cost", "ramp_months", "current_rework_share", "current_rework_minutes",
)


def value_scenarios(inputs: DataFrame) -> DataFrame:
    """Annual hours, costs, benefit and payback per scenario row, or its errors."""
    c = F.col
    bad_number = [F.when(~is_finite(c(n)) | (c(n) < 0), f"{n}:NEGATIVE") for n in REQUIRED_INPUTS]
    shares = c("auto_share") + c("escalation_share") + c("blocked_share")
    over_one = F.greatest(*[c(n) for n in _SHARES]) > 1
    cash = c("cash_realization_share")
    errors = F.array_compact(
        F.array(
            *bad_number,
            F.when(c("annual_volume") <= 0, "annual_volume:NOT_POSITIVE"),
            F.when(c("current_minutes") <= 0, "current_minutes:NOT_POSITIVE"),
            F.when(c("labor_cost_per_hour") <= 0, "labor_cost_per_hour:NOT_POSITIVE"),
            F.when(c("ramp_months") > 24, "ramp_months:TOO_LONG"),
            F.when(F.abs(shares - 1) > 0.0001, "shares:SUM"),
            F.when(over_one, "shares:RANGE"),
            F.when(cash.isNotNull() & (~is_finite(cash) | (cash < 0) | (cash > 1)), "cash_realization_share:RANGE"),
        )
    )
    df = inputs.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)

    def when_valid(value: Column) -> Column:
        return F.when(c("valid"), value)

    per_order = c("current_minutes") + c("current_rework_share") * c("current_rework_minutes")
    per_review = c("escalation_share") * c("escalation_minutes") + c("blocked_share") * c("security_minutes")
    variable = c("screening_cost") + c("extraction_cost") + c("infrastructure_cost")
    df = df.withColumns(
        {
            "current_hours": when_valid(c("annual_volume") * per_order / 60),
            "review_hours": when_valid(c("annual_volume") * per_review / 60),
            "variable_cost": when_valid(c("annual_volume") * variable),
        }
    )
    df = df.withColumns(
        {
            "current_cost": c("current_hours") * c("labor_cost_per_hour"),
            "review_cost": c("review_hours") * c("labor_cost_per_hour"),
            "released_hours": F.when(c("valid"), F.greatest(F.lit(0.0), c("current_hours") - c("review_hours"))),
        }
    )
    df = df.withColumn("equivalent_benefit", c("released_hours") * c("labor_cost_per_hour"))
    df = df.withColumn("cash_benefit", c("equivalent_benefit") * cash)
    df = df.withColumn("net_benefit", c("cash_benefit") - c("variable_cost") - c("fixed_annual_cost"))
    payback = c("one_time_cost") / c("net_benefit") * 12 + c("ramp_months") / 2
    return df.withColumn("payback_months", F.when(c("net_benefit") > 0, payback))


def kpi_rollup(items: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Outcome shares overall, per dimension and over all dimensions at once.

    Items are counted at the finest grain first, so the grouping sets expand
    counts and not items.
    """
    fine = items.groupBy(*dimensions).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("outcome") == "SHADOW_APPROVED").alias("approved"),
        F.count_if(F.col("outcome") == "REVIEW_REQUIRED").alias("review"),
        F.count_if(F.col("outcome") == "SECURITY_REVIEW").alias("blocked"),
        F.count_if(F.col("corrected")).alias("corrected"),
        F.count_if(F.col("supported_language")).alias("supported"),
    )
    names = [F.col(d) for d in dimensions]
    sets = [[], *[[n] for n in names], names]
    grouped = fine.groupingSets(sets, *names).agg(
        F.grouping_id(*names).cast("int").alias("level"),
        *[F.sum(m).alias(m) for m in ("items", "approved", "review", "blocked", "corrected", "supported")],
    )
    return grouped.withColumns({f"{m}_share": F.col(m) / F.col("items") for m in ("approved", "review", "blocked")})


def invariant_alerts(
    orders: DataFrame, events: DataFrame, verdicts: DataFrame, revisions: DataFrame
) -> DataFrame:
    """Rows that must never exist: (alert, subject).

    ``orders``: order_id, idempotency_key, trace_id.  ``events``: trace_id,
    event_type, status, outcome, kill_switch.  ``verdicts``: trace_id, verified.
    ``revisions``: trace_id, review_type, state.
    """
    doubled = orders.groupBy("idempotency_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit("DUPLICATE_ORDER").alias("alert"), F.col("idempotency_key").alias("subject")
    )
    intents = events.filter("event_type = 'erp_create_order' and status = 'intent'").select("trace_id")
    silent = orders.select("trace_id", "order_id").join(intents, "trace_id", "left_anti").select(
        F.lit("WRITE_WITHOUT_INTENT").alias("alert"), F.col("order_id").alias("subject")
    )
    commands = events.filter("event_type = 'deterministic_validation' and status = 'success'").select("trace_id")
    unapproved = orders.select("trace_id", "order_id").join(commands, "trace_id", "left_anti").select(
        F.lit("WRITE_WITHOUT_COMMAND").alias("alert"), F.col("order_id").alias("subject")
    )
    broken = verdicts.filter("not verified").select(
        F.lit("CHAIN_BROKEN").alias("alert"), F.col("trace_id").alias("subject")
    )
    killed = events.filter("event_type = 'erp_create_order' and kill_switch").select(
        F.lit("WRITE_UNDER_KILL_SWITCH").alias("alert"), F.col("trace_id").alias("subject")
    )
    strayed = revisions.filter(
        "review_type = 'security' and state in ('CORRECTED', 'REVALIDATED', 'WRITE_PENDING', 'ERP_CREATED', 'APPROVED')"
    ).select(F.lit("BLOCKED_ITEM_IN_APPROVAL").alias("alert"), F.col("trace_id").alias("subject"))
    out = doubled
    for part in (silent, unapproved, broken, killed, strayed):
        out = out.unionByName(part)
    return out.distinct()


def argument_code(name: Column, sku: Column, query: Column) -> Column:
    """Why a tool call is refused before it runs."""
    short = F.length(F.trim(query)) < 3
    return (
        F.when(~F.coalesce(name.isin(*TOOL_NAMES), F.lit(False)), "MALFORMED_TOOL_REQUEST")
        .when(
            (name == "lookup_product")
            & ~F.coalesce(sku.rlike(SKU_PATTERN) & F.length(sku).between(1, 80), F.lit(False)),
            "MALFORMED_TOOL_ARGUMENTS",
        )
        .when(
            (name == "search_products") & ~F.coalesce(F.length(query).between(3, 100), F.lit(False)),
            "MALFORMED_TOOL_ARGUMENTS",
        )
        .when((name == "search_products") & short, "EMPTY_SEARCH")
    )


def tool_budget(
    calls: DataFrame,
    max_calls: int = MAX_TOOL_CALLS,
    max_characters: int = MAX_TOOL_CHARACTERS,
    max_turns: int = MAX_TURNS,
) -> DataFrame:
    """First call per conversation that breaks a budget.

    ``calls``: conversation_id, position (unique integer), turn, characters.
    The first breach ends a run, so every earlier call was granted and plain
    running sums are what the run had used up.
    """
    counted = calls.withColumn("_one", F.lit(1))
    used = running_total(counted, ["conversation_id"], "position", {"calls": "_one", "used": "characters"})
    code = (
        F.when(F.col("turn") > max_turns, "MODEL_TURN_BUDGET")
        .when(F.col("calls") > max_calls, "TOOL_CALL_BUDGET")
        .when(F.col("used") > max_characters, "TOOL_OUTPUT_BUDGET")
    )
    breach = used.withColumn("code", code).filter("code is not null")
    return breach.groupBy("conversation_id").agg(
        F.min(F.struct("position", "code", "calls", "used")).alias("_b")
    ).select("conversation_id", "_b.*")
