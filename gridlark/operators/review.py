"""Versioned human review: latest state, legal transitions, conflicts, diffs, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Which state may follow which, and the role that may do it.
NEXT_STATES: dict[str, tuple[str, ...]] = {
    "PENDING": ("CLAIMED", "REJECTED"),
    "CLAIMED": ("CORRECTED", "REJECTED"),
    "CORRECTED": ("REVALIDATED", "REJECTED"),
    "REVALIDATED": ("WRITE_PENDING", "REJECTED"),
    "WRITE_PENDING": ("ERP_CREATED", "REJECTED"),
    "ERP_CREATED": ("APPROVED", "REJECTED"),
    "APPROVED": (),
    "REJECTED": (),
}
SYSTEM_STATES = ("PENDING", "ERP_CREATED")
ORDER_ONLY_STATES = ("CORRECTED", "REVALIDATED", "WRITE_PENDING", "APPROVED")


def latest(revisions: DataFrame) -> DataFrame:
    """Newest revision per review, by aggregation; of equal versions the one whose other columns sort last."""
    rest = [c for c in revisions.columns if c not in ("review_id", "version")]
    picked = revisions.groupBy("review_id").agg(
        F.max_by(F.struct(*rest), F.struct("version", *rest)).alias("_r"), F.max("version").alias("version")
    )
    return picked.select("review_id", "version", "_r.*")


def may_follow(before: Column, state: Column) -> Column:
    allowed = F.lit(False)
    for source, targets in NEXT_STATES.items():
        if targets:
            allowed = allowed | ((before == source) & state.isin(*targets))
    return allowed


def required_role(review_type: Column, state: Column) -> Column:
    return (
        F.when(state.isin(*SYSTEM_STATES), "SYSTEM")
        .when((review_type == "security") & ~state.isin(*ORDER_ONLY_STATES), "SECURITY_REVIEWER")
        .otherwise("ORDER_REVIEWER")
    )


def check_transitions(revisions: DataFrame) -> DataFrame:
    """First reason each revision is not legal, NULL when it is.

    ``revisions``: review_id, review_type, version, state, actor_id, actor_role.
    The predecessor comes by an equi-join on (review, version - 1) and the owner
    from one aggregate, so a review with very many revisions needs no sort.
    """
    keyed = revisions.groupBy("review_id", "version").agg(
        F.min("state").alias("_before"), F.count(F.lit(1)).alias("_copies")
    )
    before = keyed.select("review_id", (F.col("version") + 1).alias("version"), "_before")
    copies = keyed.select("review_id", "version", "_copies")
    claim = F.when(F.col("state") == "CLAIMED", F.col("version"))
    owner = revisions.groupBy("review_id").agg(F.min_by("actor_id", claim).alias("_owner"))
    joined = (
        revisions.join(before, ["review_id", "version"], "left")
        .join(copies, ["review_id", "version"])
        .join(owner, "review_id")
    )
    state, prior = F.col("state"), F.col("_before")
    owned = ~state.isin("PENDING", "CLAIMED", "ERP_CREATED") & ~((state == "REJECTED") & (prior == "PENDING"))
    code = (
        F.when(F.col("_copies") > 1, "VERSION_REPEATED")
        .when((F.col("version") == 1) & (state != "PENDING"), "FIRST_NOT_PENDING")
        .when((F.col("version") > 1) & prior.isNull(), "VERSION_GAP")
        .when((F.col("version") > 1) & ~may_follow(prior, state), "ILLEGAL_TRANSITION")
        .when((F.col("review_type") == "security") & state.isin(*ORDER_ONLY_STATES), "SECURITY_REVIEW_ONLY")
        .when(F.col("actor_role") != required_role(F.col("review_type"), state), "ROLE_REQUIRED")
        .when(owned & ~F.col("actor_id").eqNullSafe(F.col("_owner")), "NOT_OWNER")
    )
    return joined.withColumn("code", code).drop("_before", "_copies", "_owner")


def version_conflicts(revisions: DataFrame) -> DataFrame:
    """Revisions whose version is taken or does not follow the one before."""
    keyed = revisions.groupBy("review_id", "version").agg(F.count(F.lit(1)).alias("copies"))
    before = keyed.select("review_id", (F.col("version") + 1).alias("version"), F.lit(True).alias("_has"))
    joined = keyed.join(before, ["review_id", "version"], "left")
    gap = (F.col("version") > 1) & F.col("_has").isNull()
    code = F.when(F.col("copies") > 1, "VERSION_REPEATED").when(gap, "VERSION_GAP")
    return joined.withColumn("code", code).filter("code is not null").drop("_has")


def _leaves(schema: T.StructType, column: Column, prefix: str = "") -> list[tuple[str, Column]]:
    out: list[tuple[str, Column]] = []
    for field in sorted(schema.fields, key=lambda f: f.name):
        path = f"{prefix}.{field.name}" if prefix else field.name
        inner = column[field.name]
        if isinstance(field.dataType, T.StructType):
            out.extend(_leaves(field.dataType, inner, path))
        else:
            out.append((path, inner))
    return out


def changed_fields(schema: T.StructType, before: Column, after: Column) -> Column:
    """Sorted paths that differ between two nested records; lists compare whole."""
    pairs = zip(_leaves(schema, before), _leaves(schema, after))
    changed = [F.when(~a.eqNullSafe(b), path) for (path, a), (_, b) in pairs]
    return F.array_compact(F.array(*changed))


def correction_code(changes: Column, evidence_count: Column, confidence_kept: Column) -> Column:
    """Why a correction is refused, NULL when it stands."""
    only_ambiguities = F.forall(changes, lambda c: c == "ambiguities")
    return (
        F.when(~confidence_kept, "CONFIDENCE_REWRITTEN")
        .when(F.size(changes) == 0, "NOTHING_CHANGED")
        .when(evidence_count == 0, "EVIDENCE_REQUIRED")
        .when(only_ambiguities, "AMBIGUITY_CLEARED_ALONE")
    )


def unreceipted_approvals(revisions: DataFrame, events: DataFrame) -> DataFrame:
    """Approvals without a successful write event of the named id on the same trace."""
    receipts = events.filter("status = 'success' and outcome = 'ERP_CREATED'").select(
        "trace_id", F.col("event_id").alias("write_audit_event_id")
    )
    approvals = revisions.filter("state = 'APPROVED'")
    return approvals.join(receipts, ["trace_id", "write_audit_event_id"], "left_anti")
