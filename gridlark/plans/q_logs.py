"""Audit log, review log, tool budget and KPI queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridlark.functions import jsontree, numeric as num
from gridlark.functions.hashing import DIGEST_PATTERN
from gridlark.operators import audit, contracts, kpi, review
from gridlark.operators.ordered import number_within
from gridlark.plans import derive as dv
from gridlark.plans.registry import register
from gridlark.session import materialize
from gridlark.sources.tables import read_shared as table

# ---- audit log: one trace per user, events in time order --------------------------

SEQ_SQL = """seq AS (SELECT user_id AS trace_id, event_id, event_type, props, strftime(ts, '%Y-%m-%d %H:%M:%S') AS occurred_at,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events),
digested AS (SELECT *, sha256(to_json({'event_id': event_id, 'event_type': event_type, 'occurred_at': occurred_at, 'payload': props})) AS content_digest FROM seq)"""

CHAIN_SQL = """chain AS (
  SELECT trace_id, sequence, content_digest, repeat('0', 64) AS previous_hash, sha256(content_digest || repeat('0', 64)) AS event_hash FROM digested WHERE sequence = 1
  UNION ALL SELECT d.trace_id, d.sequence, d.content_digest, c.event_hash, sha256(d.content_digest || c.event_hash)
  FROM chain c JOIN digested d ON d.trace_id = c.trace_id AND d.sequence = c.sequence + 1)"""


def log(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their sequence; two tables below use it, so it is materialised by numbering."""
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("trace_id"), "event_id", "event_type", "props", "ts"
    )
    return audit.with_sequence(events, ("ts", "event_id")).withColumn("occurred_at", dv.text_time("ts")).drop("ts")


def digested(df: DataFrame) -> DataFrame:
    fields = {
        "event_id": F.col("event_id"), "event_type": F.col("event_type"),
        "occurred_at": F.col("occurred_at"), "payload": F.col("props"),
    }
    return df.withColumn("content_digest", audit.content_digest(fields))


@register("audit_sequence", "WITH " + SEQ_SQL + " SELECT trace_id, event_id, sequence, content_digest FROM digested")
def audit_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return digested(log(spark, folder)).select("trace_id", "event_id", "sequence", "content_digest")


@register("audit_chain", "WITH RECURSIVE " + SEQ_SQL + ",\n" + CHAIN_SQL + " SELECT trace_id, sequence, previous_hash, event_hash FROM chain")
def audit_chain(spark: SparkSession, folder: str) -> DataFrame:
    return audit.build_chain(digested(log(spark, folder)))


TAMPERED_SQL = """tampered AS (SELECT d.trace_id, d.event_id, d.sequence, c.previous_hash, c.event_hash,
  CASE WHEN d.event_id % 97 = 0 THEN sha256(d.content_digest) ELSE d.content_digest END AS content_digest
  FROM digested d JOIN chain c USING (trace_id, sequence) WHERE d.event_id % 331 <> 0),
linked AS (SELECT t.*, p.event_hash AS before FROM tampered t LEFT JOIN tampered p ON p.trace_id = t.trace_id AND p.sequence = t.sequence - 1),
judged AS (SELECT *, CASE WHEN sequence > 1 AND before IS NULL THEN 'SEQUENCE_GAP' WHEN previous_hash <> CASE WHEN sequence = 1 THEN repeat('0', 64) ELSE before END THEN 'PREVIOUS_HASH'
  WHEN event_hash <> sha256(content_digest || previous_hash) THEN 'EVENT_HASH' END AS code FROM linked)"""


def tampered(spark: SparkSession, folder: str) -> DataFrame:
    """The chained log after someone removed some events and rewrote others."""
    full = materialize(digested(log(spark, folder)).select("trace_id", "event_id", "sequence", "content_digest"))
    chained = full.join(audit.build_chain(full), ["trace_id", "sequence"])
    rewritten = F.when(F.col("event_id") % 97 == 0, F.sha2("content_digest", 256)).otherwise(F.col("content_digest"))
    return chained.filter("event_id % 331 <> 0").withColumn("content_digest", rewritten)


@register(
    "audit_verify",
    "WITH RECURSIVE " + SEQ_SQL + ",\n" + CHAIN_SQL + ",\n" + TAMPERED_SQL
    + """ SELECT trace_id, COUNT(*) AS events, COUNT(code) = 0 AS verified, MIN(sequence) FILTER (code IS NOT NULL) AS first_break,
 arg_min(code, sequence) FILTER (code IS NOT NULL) AS break_code FROM judged GROUP BY 1""",
)
def audit_verify(spark: SparkSession, folder: str) -> DataFrame:
    return audit.verify_traces(tampered(spark, folder))


@register(
    "intent_pairing",
    """WITH log AS (SELECT event_id // 4 AS trace_id, event_id, CASE event_type WHEN 'view' THEN 'intent' WHEN 'click' THEN 'success' WHEN 'purchase' THEN 'denied' WHEN 'error' THEN 'failure' ELSE 'intent' END AS status,
  CASE WHEN event_type <> 'view' THEN event_id - 1 END AS intent_event_id FROM events)
SELECT trace_id, event_id, 'OUTCOME_WITHOUT_INTENT' AS problem FROM log o WHERE intent_event_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM log i WHERE i.status = 'intent' AND i.trace_id = o.trace_id AND i.event_id = o.intent_event_id)
UNION ALL SELECT trace_id, event_id, 'OUTCOME_IS_INTENT' FROM log WHERE intent_event_id IS NOT NULL AND status = 'intent'
UNION ALL SELECT trace_id, event_id, 'INTENT_OPEN' FROM log i WHERE status = 'intent' AND NOT EXISTS (SELECT 1 FROM log o WHERE o.trace_id = i.trace_id AND o.intent_event_id = i.event_id)""",
)
def intent_pairing(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    events = table(spark, folder, "events").select(
        F.floor(F.col("event_id") / 4).alias("trace_id"), "event_id",
        F.when(kind == "click", "success").when(kind == "purchase", "denied").when(kind == "error", "failure")
        .otherwise("intent").alias("status"),
        F.when(kind != "view", F.col("event_id") - 1).alias("intent_event_id"),
    )
    return audit.pair_intents(events)


_WORD = r"[\p{L}\p{N}_"
REDACT_SQL = rf"""WITH cleaned AS (SELECT doc_id, regexp_replace(regexp_replace(text || ' seen by clerk' || doc_id || '@mail.example.org, thanks', '(?i)bearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g'),
  '{_WORD}.+-]+@{_WORD}.-]+\.[A-Za-z]{{2,}}([^\p{{L}}\p{{N}}_.-]|$)', '[REDACTED_EMAIL]\1', 'g') AS note FROM documents)
SELECT doc_id, CASE WHEN length(note) > 512 OR length(note) - length(replace(note, chr(10), '')) > 4 THEN '[REDACTED_TEXT sha256=' || sha256(note) || ']' ELSE note END AS note,
 '[REDACTED]' AS api_key, '[REDACTED]' AS reset_token, 'Authorization: Bearer [REDACTED] end' AS header FROM cleaned"""


@register("audit_redaction", REDACT_SQL)
def audit_redaction(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    payload = F.create_map(
        F.lit("note"), F.concat("text", F.lit(" seen by clerk"), number, F.lit("@mail.example.org, thanks")),
        F.lit("Api-Key"), number, F.lit("reset_token"), number,
        F.lit("header"), F.concat(F.lit("Authorization: bearer abc."), number, F.lit(" end")),
    )
    safe = audit.redacted(table(spark, folder, "documents").select("doc_id", payload.alias("payload")))
    return safe.select(
        "doc_id", F.col("payload")["note"].alias("note"), F.col("payload")["Api-Key"].alias("api_key"),
        F.col("payload")["reset_token"].alias("reset_token"), F.col("payload")["header"].alias("header"),
    )


@register(
    "trace_log",
    "WITH " + SEQ_SQL + " SELECT trace_id, sequence, occurred_at, CAST(to_json({'event_type': event_type, 'props': props}) AS VARCHAR) AS payload FROM seq",
)
def trace_log(spark: SparkSession, folder: str) -> DataFrame:
    events = log(spark, folder).withColumn("payload", F.struct("event_type", "props"))
    return audit.trace_log(events).select("trace_id", "sequence", "occurred_at", "payload")


# ---- review log: one review per customer, one revision per order ---------------------

REVIEWS_SQL = """numbered AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
revisions AS (SELECT o_custkey AS review_id, 't' || o_orderkey AS trace_id, o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'security' ELSE 'order' END AS review_type,
  rn + CASE WHEN rn > 5 AND o_custkey % 7 = 0 THEN 1 WHEN rn > 3 AND o_custkey % 11 = 0 THEN -1 ELSE 0 END AS version,
  CASE WHEN rn > 2 AND o_orderpriority = '1-URGENT' THEN 'REJECTED' ELSE (['PENDING','CLAIMED','CORRECTED','REVALIDATED','WRITE_PENDING','ERP_CREATED','APPROVED'])[LEAST(rn, 7)] END AS state,
  CASE WHEN o_orderkey % 13 = 0 THEN 'a9' ELSE 'a' || (o_custkey % 3) END AS actor_id,
  CASE WHEN o_totalprice < 40000 THEN 'SYSTEM' WHEN rn = 1 OR (rn = 6 AND NOT (o_orderpriority = '1-URGENT')) THEN 'SYSTEM' WHEN o_custkey % 5 = 0 THEN 'SECURITY_REVIEWER' ELSE 'ORDER_REVIEWER' END AS actor_role
  FROM numbered)"""

_STATES = ("PENDING", "CLAIMED", "CORRECTED", "REVALIDATED", "WRITE_PENDING", "ERP_CREATED", "APPROVED")


def revisions(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice"
    )
    rows = number_within(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "rn")
    rn, customer, urgent = F.col("rn"), F.col("o_custkey"), F.col("o_orderpriority") == "1-URGENT"
    shift = F.when((rn > 5) & (customer % 7 == 0), 1).when((rn > 3) & (customer % 11 == 0), -1).otherwise(0)
    step = F.element_at(F.array(*[F.lit(s) for s in _STATES]), F.least(rn, F.lit(7)).cast("int"))
    return rows.select(
        customer.alias("review_id"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("trace_id"), "o_orderkey",
        F.when(customer % 5 == 0, "security").otherwise("order").alias("review_type"),
        (rn + shift).alias("version"),
        F.when((rn > 2) & urgent, "REJECTED").otherwise(step).alias("state"),
        F.when(F.col("o_orderkey") % 13 == 0, "a9").otherwise(F.concat(F.lit("a"), (customer % 3).cast("string"))).alias("actor_id"),
        F.when(F.col("o_totalprice") < 40000, "SYSTEM").when((rn == 1) | ((rn == 6) & ~urgent), "SYSTEM")
        .when(customer % 5 == 0, "SECURITY_REVIEWER").otherwise("ORDER_REVIEWER").alias("actor_role"),
    )


@register(
    "review_latest",
    "WITH " + REVIEWS_SQL + """ SELECT review_id, MAX(version) AS version, arg_max(state, struct_pack(v := version, s := state)) AS state FROM revisions GROUP BY 1""",
)
def review_latest(spark: SparkSession, folder: str) -> DataFrame:
    # Of two revisions that share the newest version, the state that sorts last counts.
    return review.latest(revisions(spark, folder).select("review_id", "version", "state"))


@register(
    "review_transitions",
    "WITH " + REVIEWS_SQL + """,
keyed AS (SELECT review_id, version, MIN(state) AS state, COUNT(*) AS copies FROM revisions GROUP BY ALL),
owners AS (SELECT review_id, arg_min(actor_id, version) AS owner FROM revisions WHERE state = 'CLAIMED' GROUP BY 1),
joined AS (SELECT r.*, k.copies, p.state AS prior, o.owner FROM revisions r JOIN keyed k USING (review_id, version)
  LEFT JOIN keyed p ON p.review_id = r.review_id AND p.version = r.version - 1 LEFT JOIN owners o ON o.review_id = r.review_id)
SELECT review_id, o_orderkey, version, state, CASE WHEN copies > 1 THEN 'VERSION_REPEATED' WHEN version = 1 AND state <> 'PENDING' THEN 'FIRST_NOT_PENDING'
 WHEN version > 1 AND prior IS NULL THEN 'VERSION_GAP'
 WHEN version > 1 AND NOT ((state = 'REJECTED' AND prior NOT IN ('APPROVED', 'REJECTED')) OR (prior || '>' || state) IN ('PENDING>CLAIMED','CLAIMED>CORRECTED','CORRECTED>REVALIDATED','REVALIDATED>WRITE_PENDING','WRITE_PENDING>ERP_CREATED','ERP_CREATED>APPROVED')) THEN 'ILLEGAL_TRANSITION'
 WHEN review_type = 'security' AND state IN ('CORRECTED','REVALIDATED','WRITE_PENDING','APPROVED') THEN 'SECURITY_REVIEW_ONLY'
 WHEN actor_role <> CASE WHEN state IN ('PENDING','ERP_CREATED') THEN 'SYSTEM' WHEN review_type = 'security' THEN 'SECURITY_REVIEWER' ELSE 'ORDER_REVIEWER' END THEN 'ROLE_REQUIRED'
 WHEN state NOT IN ('PENDING','CLAIMED','ERP_CREATED') AND NOT (state = 'REJECTED' AND prior IS NOT DISTINCT FROM 'PENDING') AND actor_id IS DISTINCT FROM owner THEN 'NOT_OWNER' END AS code
FROM joined""",
)
def review_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return review.check_transitions(revisions(spark, folder)).select("review_id", "o_orderkey", "version", "state", "code")


@register(
    "review_conflicts",
    "WITH " + REVIEWS_SQL + """, keyed AS (SELECT review_id, version, COUNT(*) AS copies FROM revisions GROUP BY ALL)
SELECT review_id, version, copies, CASE WHEN copies > 1 THEN 'VERSION_REPEATED' ELSE 'VERSION_GAP' END AS code FROM keyed k
WHERE copies > 1 OR (version > 1 AND NOT EXISTS (SELECT 1 FROM keyed p WHERE p.review_id = k.review_id AND p.version = k.version - 1))""",
)
def review_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return review.version_conflicts(revisions(spark, folder))


PROPOSAL = T.StructType(
    [
        T.StructField("ambiguities", T.ArrayType(T.StringType())),
        T.StructField("detected_language", T.StringType()),
        T.StructField(
            "delivery",
            T.StructType([T.StructField("status", T.StringType()), T.StructField("year", T.IntegerType())]),
        ),
    ]
)


@register(
    "review_diff",
    """WITH n AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, year(o_orderdate) AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
d AS (SELECT a.o_custkey AS review_id, a.rn AS version, concat_ws(',', CASE WHEN a.o_orderpriority || a.o_orderstatus <> b.o_orderpriority || b.o_orderstatus THEN 'ambiguities' END,
  CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'delivery.status' END, CASE WHEN a.y <> b.y THEN 'delivery.year' END,
  CASE WHEN a.o_orderpriority <> b.o_orderpriority THEN 'detected_language' END) AS changes, a.o_orderkey % 9 AS evidence FROM n a JOIN n b ON b.o_custkey = a.o_custkey AND b.rn = a.rn - 1)
SELECT review_id, version, changes, CASE WHEN changes = '' THEN 'NOTHING_CHANGED' WHEN evidence = 0 THEN 'EVIDENCE_REQUIRED' WHEN changes = 'ambiguities' THEN 'AMBIGUITY_CLEARED_ALONE' END AS code FROM d""",
)
def review_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive proposals of a review compared field by field."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    rows = number_within(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "version")
    proposal = F.struct(
        F.array("o_orderpriority", "o_orderstatus").alias("ambiguities"), F.col("o_orderpriority").alias("detected_language"),
        F.struct(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year")).alias("delivery"),
    )
    after = rows.select(F.col("o_custkey").alias("review_id"), "version", "o_orderkey", proposal.alias("after"))
    before = after.select("review_id", (F.col("version") + 1).alias("version"), F.col("after").alias("before"))
    joined = after.join(before, ["review_id", "version"])
    changes = review.changed_fields(PROPOSAL, F.col("before"), F.col("after"))
    out = joined.withColumn("_c", changes)
    code = review.correction_code(F.col("_c"), F.col("o_orderkey") % 9, F.lit(True))
    return out.select("review_id", "version", F.array_join("_c", ",").alias("changes"), code.alias("code"))


@register(
    "approval_receipts",
    "WITH " + REVIEWS_SQL + """ SELECT review_id, trace_id FROM revisions r WHERE state = 'APPROVED' AND NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = r.o_orderkey AND l_linestatus = 'O' AND l_returnflag <> 'R')""",
)
def approval_receipts(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("l_linestatus") == "O", "success").otherwise("failure")
    outcome = F.when(F.col("l_returnflag") != "R", "ERP_CREATED")
    events = table(spark, folder, "lineitem").select(
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("trace_id"),
        F.col("l_orderkey").alias("event_id"), status.alias("status"), outcome.alias("outcome"),
    )
    named = revisions(spark, folder).withColumnRenamed("o_orderkey", "write_audit_event_id")
    return review.unreceipted_approvals(named, events).select("review_id", "trace_id")


# ---- tool calls: a call per text line of a conversation turn ---------------------------

CALLS_SQL = """calls AS (SELECT conv_id AS conversation_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS position, turn + 1 AS turn, length(t) AS characters FROM (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations))"""


@register(
    "tool_budget",
    "WITH " + CALLS_SQL + """, used AS (SELECT *, COUNT(*) OVER w AS calls, SUM(characters) OVER w AS used FROM calls WINDOW w AS (PARTITION BY conversation_id ORDER BY position)),
breach AS (SELECT *, CASE WHEN turn > 6 THEN 'MODEL_TURN_BUDGET' WHEN calls > 8 THEN 'TOOL_CALL_BUDGET' WHEN used > 1500 THEN 'TOOL_OUTPUT_BUDGET' END AS code FROM used)
SELECT conversation_id, position, code, calls, CAST(used AS BIGINT) AS used FROM breach WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY position) = 1""",
)
def tool_budget(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("conversation_id"), "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    numbered = number_within(lines, ["conversation_id"], ["turn", "pos"], "position")
    calls = numbered.select("conversation_id", "position", (F.col("turn") + 1).alias("turn"), F.length("line").alias("characters"))
    return kpi.tool_budget(calls, max_characters=1500)


@register(
    "tool_argument_rules",
    """WITH calls AS (SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'lookup_product' WHEN 'MEDIUM' THEN 'search_products' WHEN 'LARGE' THEN 'purchase_history' WHEN 'PROMO' THEN 'lookup_product' WHEN 'STANDARD' THEN 'search_products' ELSE 'drop_table' END AS name,
  CASE p_type WHEN 'SMALL' THEN p_name ELSE replace(p_brand, '#', CASE WHEN p_size % 2 = 0 THEN '-' ELSE '#' END) END AS sku,
  CASE p_type WHEN 'MEDIUM' THEN substr(p_name, 1, p_size % 6) ELSE '  ' || substr(p_name, 1, p_size % 4) END AS query FROM part)
SELECT p_partkey, CASE WHEN name = 'drop_table' THEN 'MALFORMED_TOOL_REQUEST' WHEN name = 'lookup_product' AND NOT regexp_full_match(sku, '[A-Za-z0-9][A-Za-z0-9._-]*') THEN 'MALFORMED_TOOL_ARGUMENTS'
 WHEN name = 'search_products' AND NOT length(query) BETWEEN 3 AND 100 THEN 'MALFORMED_TOOL_ARGUMENTS' WHEN name = 'search_products' AND length(trim(query)) < 3 THEN 'EMPTY_SEARCH' END AS code FROM calls""",
)
def tool_argument_rules(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("p_type")
    name = (
        F.when(kind.isin("SMALL", "PROMO"), "lookup_product").when(kind.isin("MEDIUM", "STANDARD"), "search_products")
        .when(kind == "LARGE", "purchase_history").otherwise("drop_table")
    )
    mark = F.when(F.col("p_size") % 2 == 0, "-").otherwise("#")
    sku = F.when(kind == "SMALL", F.col("p_name")).otherwise(F.replace("p_brand", F.lit("#"), mark))
    query = F.when(kind == "MEDIUM", F.expr("substr(p_name, 1, p_size % 6)")).otherwise(
        F.concat(F.lit("  "), F.expr("substr(p_name, 1, p_size % 4)"))
    )
    return table(spark, folder, "part").select("p_partkey", kpi.argument_code(name, sku, query).alias("code"))


# ---- KPIs ---------------------------------------------------------------------------

@register(
    "promotion_gate",
    """SELECT l_suppkey AS segment, COUNT(*) AS reviewed, COUNT(*) FILTER (defect) AS defects, CAST(299 AS BIGINT) AS required,
 CASE WHEN COUNT(*) FILTER (defect) = 0 THEN ROUND(1 - pow(1 - 0.95, 1.0 / COUNT(*)), 9) END AS upper_bound, COUNT(*) FILTER (defect) = 0 AND COUNT(*) >= 299 AS promoted
FROM (SELECT l_suppkey, l_discount > 0.095 AND l_tax < 0.005 AND l_quantity > 35 AS defect FROM lineitem) GROUP BY 1""",
)
def promotion_gate(spark: SparkSession, folder: str) -> DataFrame:
    defect = (F.col("l_discount") > 0.095) & (F.col("l_tax") < 0.005) & (F.col("l_quantity") > 35)
    reviews = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("segment"), defect.alias("defect"))
    out = kpi.promotion_gate(reviews, ["segment"])
    return out.withColumn("upper_bound", F.round("upper_bound", 9))


@register(
    "value_scenarios",
    """WITH i AS (SELECT c_custkey, CAST(c_custkey % 40 * 500 AS DOUBLE) AS volume, CAST(c_nationkey AS DOUBLE) AS minutes, 48.0::DOUBLE AS labor, 0.55::DOUBLE AS auto_s,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS esc, 0.05::DOUBLE AS blocked, c_acctbal AS fixed, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 0.5::DOUBLE END AS cash FROM customer),
o AS (SELECT *, volume * (minutes + 0.04::DOUBLE * 10) / 60 AS cur, volume * (esc * 8 + blocked * 5) / 60 AS rev, volume * (0.02::DOUBLE + 0.1::DOUBLE + 0.04::DOUBLE) AS var,
  concat_ws(',', CASE WHEN fixed < 0 THEN 'fixed_annual_cost:NEGATIVE' END, CASE WHEN volume <= 0 THEN 'annual_volume:NOT_POSITIVE' END, CASE WHEN minutes <= 0 THEN 'current_minutes:NOT_POSITIVE' END,
   CASE WHEN abs(auto_s + esc + blocked - 1) > 0.0001 THEN 'shares:SUM' END) AS errors FROM i),
b AS (SELECT *, GREATEST(0, cur - rev) AS released, GREATEST(0, cur - rev) * labor * cash - var - fixed AS net FROM o)
SELECT c_custkey AS scenario, errors, errors = '' AS valid, CASE WHEN errors = '' THEN ROUND(cur, 4) END AS current_hours, CASE WHEN errors = '' THEN ROUND(rev, 4) END AS review_hours,
 CASE WHEN errors = '' THEN ROUND(released, 4) END AS released_hours, CASE WHEN errors = '' THEN ROUND(net, 4) END AS net_benefit,
 CASE WHEN errors = '' AND net > 0 THEN ROUND(20000 / net * 12 + 3, 4) END AS payback_months FROM b""",
)
def value_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    fixed = {
        "labor_cost_per_hour": 48.0, "auto_share": 0.55, "blocked_share": 0.05, "escalation_minutes": 8.0,
        "security_minutes": 5.0, "screening_cost": 0.02, "extraction_cost": 0.1, "infrastructure_cost": 0.04,
        "one_time_cost": 20000.0, "ramp_months": 6.0, "current_rework_share": 0.04, "current_rework_minutes": 10.0,
    }
    inputs = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("scenario"),
        (F.col("c_custkey") % 40 * 500).cast("double").alias("annual_volume"),
        F.col("c_nationkey").cast("double").alias("current_minutes"),
        F.when(F.col("c_mktsegment") == "MACHINERY", 0.5).otherwise(0.4).alias("escalation_share"),
        F.col("c_acctbal").alias("fixed_annual_cost"),
        F.when(F.col("c_custkey") % 3 != 0, 0.5).alias("cash_realization_share"),
        *[F.lit(v).alias(n) for n, v in fixed.items()],
    )
    out = kpi.value_scenarios(inputs)
    rounded = ("current_hours", "review_hours", "released_hours", "net_benefit", "payback_months")
    return out.select(
        "scenario", F.array_join("errors", ",").alias("errors"), "valid", *[F.round(n, 4).alias(n) for n in rounded]
    )


@register(
    "kpi_rollup",
    """WITH items AS (SELECT CASE o_orderstatus WHEN 'P' THEN 'shadow' WHEN 'O' THEN 'auto' ELSE 'replay' END AS mode, o_orderpriority AS language, CAST(o_custkey % 3 AS VARCHAR) AS kind,
  CASE WHEN o_totalprice < 100000 THEN 'SECURITY_REVIEW' WHEN o_totalprice < 250000 THEN 'REVIEW_REQUIRED' ELSE 'SHADOW_APPROVED' END AS outcome, o_orderkey % 6 = 0 AS corrected, o_orderpriority <> '5-LOW' AS ok FROM orders)
SELECT mode, language, kind, CAST(grouping(mode) * 4 + grouping(language) * 2 + grouping(kind) AS INTEGER) AS level, COUNT(*) AS items, COUNT(*) FILTER (outcome = 'SHADOW_APPROVED') AS approved,
 COUNT(*) FILTER (outcome = 'REVIEW_REQUIRED') AS review, COUNT(*) FILTER (outcome = 'SECURITY_REVIEW') AS blocked, COUNT(*) FILTER (corrected) AS corrected, COUNT(*) FILTER (ok) AS supported,
 ROUND(COUNT(*) FILTER (outcome = 'SHADOW_APPROVED') / COUNT(*), 9) AS approved_share FROM items GROUP BY GROUPING SETS ((), (mode), (language), (kind), (mode, language, kind))""",
)
def kpi_rollup(spark: SparkSession, folder: str) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    items = table(spark, folder, "orders").select(
        F.when(status == "P", "shadow").when(status == "O", "auto").otherwise("replay").alias("mode"),
        F.col("o_orderpriority").alias("language"), (F.col("o_custkey") % 3).cast("string").alias("kind"),
        F.when(price < 100000, "SECURITY_REVIEW").when(price < 250000, "REVIEW_REQUIRED").otherwise("SHADOW_APPROVED").alias("outcome"),
        (F.col("o_orderkey") % 6 == 0).alias("corrected"), (F.col("o_orderpriority") != "5-LOW").alias("supported_language"),
    )
    out = kpi.kpi_rollup(items, ["mode", "language", "kind"])
    return out.withColumn("approved_share", F.round("approved_share", 9)).drop("review_share", "blocked_share")


@register(
    "run_rollup",
    """SELECT mode, COUNT(*) AS runs, CAST(SUM(audit_events) AS BIGINT) AS audit_events, bool_and(audit_verified) AS all_verified, CAST(SUM(writes) AS BIGINT) AS writes, CAST(SUM(CASE WHEN blocked THEN writes ELSE 0 END) AS BIGINT) AS blocked_writes
FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'shadow' WHEN 1 THEN 'auto' ELSE 'replay' END AS mode, COUNT(*) AS audit_events, MAX(value) < 400 OR user_id % 3 = 0 AS audit_verified, COUNT(*) FILTER (event_type = 'purchase') AS writes, MIN(value) < 0.1 AS blocked FROM events GROUP BY user_id) GROUP BY 1""",
)
def run_rollup(spark: SparkSession, folder: str) -> DataFrame:
    third = F.col("user_id") % 3
    runs = table(spark, folder, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("audit_events"), ((F.max("value") < 400) | F.any_value(third == 0)).alias("audit_verified"),
        F.count_if(F.col("event_type") == "purchase").alias("writes"), (F.min("value") < 0.1).alias("blocked"),
    )
    moded = runs.withColumn("mode", F.when(third == 0, "shadow").when(third == 1, "auto").otherwise("replay"))
    return kpi.run_rollup(moded)


ALERTS_SQL = """WITH made AS (SELECT o_orderkey, 'ORD-' || o_orderkey AS order_id, o_custkey || '/' || o_orderpriority AS idempotency_key, 't' || o_orderkey AS trace_id FROM orders),
log AS (SELECT 't' || l_orderkey AS trace_id, CASE l_returnflag WHEN 'A' THEN 'erp_create_order' ELSE 'deterministic_validation' END AS event_type, CASE l_linestatus WHEN 'O' THEN 'intent' ELSE 'success' END AS status, l_discount > 0.095 AND l_tax > 0.075 AS kill_switch FROM lineitem)
SELECT DISTINCT alert, subject FROM (
 SELECT 'DUPLICATE_ORDER' AS alert, idempotency_key AS subject FROM made GROUP BY 2 HAVING COUNT(*) > 1
 UNION ALL SELECT 'WRITE_WITHOUT_INTENT', order_id FROM made WHERE trace_id NOT IN (SELECT trace_id FROM log WHERE event_type = 'erp_create_order' AND status = 'intent')
 UNION ALL SELECT 'WRITE_WITHOUT_COMMAND', order_id FROM made WHERE trace_id NOT IN (SELECT trace_id FROM log WHERE event_type = 'deterministic_validation' AND status = 'success')
 UNION ALL SELECT 'CHAIN_BROKEN', 't' || o_orderkey FROM orders WHERE o_totalprice > 495000
 UNION ALL SELECT 'WRITE_UNDER_KILL_SWITCH', trace_id FROM log WHERE event_type = 'erp_create_order' AND kill_switch
 UNION ALL SELECT 'BLOCKED_ITEM_IN_APPROVAL', 't' || o_orderkey FROM orders WHERE o_custkey % 5 = 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH'))"""


@register("invariant_alerts", ALERTS_SQL)
def invariant_alerts(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    trace = F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("trace_id")
    made = orders.select(
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("order_id"),
        F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("idempotency_key"), trace,
    )
    events = table(spark, folder, "lineitem").select(
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("trace_id"),
        F.when(F.col("l_returnflag") == "A", "erp_create_order").otherwise("deterministic_validation").alias("event_type"),
        F.when(F.col("l_linestatus") == "O", "intent").otherwise("success").alias("status"),
        ((F.col("l_discount") > 0.095) & (F.col("l_tax") > 0.075)).alias("kill_switch"),
    )
    verdicts = orders.select(trace, (F.col("o_totalprice") <= 495000).alias("verified"))
    states = F.when(F.col("o_orderpriority") == "1-URGENT", "APPROVED").when(F.col("o_orderpriority") == "2-HIGH", "CORRECTED").otherwise("CLAIMED")
    revised = orders.select(trace, F.when(F.col("o_custkey") % 5 == 0, "security").otherwise("order").alias("review_type"), states.alias("state"))
    return kpi.invariant_alerts(made, events, verdicts, revised)


# ---- small contracts over nested and textual fields -------------------------------------

@register(
    "json_shape",
    """WITH t AS (SELECT event_id, CASE event_type WHEN 'view' THEN props WHEN 'click' THEN '{"k": 1, "k": 2}' WHEN 'error' THEN '{"k": ' WHEN 'signup' THEN '{"x": 3}' ELSE '{"k": "' || event_id || 'x"}' END AS body, event_type, props FROM events)
SELECT event_id, CASE event_type WHEN 'view' THEN 'OK' WHEN 'click' THEN 'KEY_REPEATED' WHEN 'error' THEN 'MALFORMED' WHEN 'signup' THEN 'SHAPE' ELSE 'SHAPE' END AS verdict,
 CASE WHEN event_type = 'view' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM t""",
)
def json_shape(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    body = (
        F.when(kind == "view", F.col("props")).when(kind == "click", '{"k": 1, "k": 2}').when(kind == "error", '{"k": ')
        .when(kind == "signup", '{"x": 3}').otherwise(F.concat(F.lit('{"k": "'), F.col("event_id").cast("string"), F.lit('x"}')))
    )
    df = table(spark, folder, "events").select("event_id", body.alias("body"))
    keys = F.json_object_keys("body")
    value = F.get_json_object("body", "$.k").try_cast("bigint")
    verdict = (
        F.when(F.try_parse_json("body").isNull() & keys.isNull(), "MALFORMED")
        .when(F.size(keys) != F.size(F.array_distinct(keys)), "KEY_REPEATED")
        .when(value.isNull(), "SHAPE")
        .otherwise("OK")
    )
    return df.select("event_id", verdict.alias("verdict"), F.when(verdict == "OK", value).alias("k"))


NESTED_SQL = """t AS (SELECT event_id, event_type, CASE event_type
  WHEN 'view' THEN '{"a": [1, {"b": {"k": ' || event_id || '}}], "k": 2}' WHEN 'click' THEN '{"a": [{"b": {"k": 1, "j": [], "k": ' || event_id || '}}]}'
  WHEN 'error' THEN '{"a": {"k": ' WHEN 'signup' THEN '{"x": 3, "y": null, "x": 4}' ELSE '[{"k": 1}, {"k": 1}]' END AS body FROM events)"""


def _nested(spark: SparkSession, folder: str) -> DataFrame:
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    body = (
        F.when(kind == "view", F.concat(F.lit('{"a": [1, {"b": {"k": '), number, F.lit('}}], "k": 2}')))
        .when(kind == "click", F.concat(F.lit('{"a": [{"b": {"k": 1, "j": [], "k": '), number, F.lit("}}]}")))
        .when(kind == "error", '{"a": {"k": ').when(kind == "signup", '{"x": 3, "y": null, "x": 4}').otherwise('[{"k": 1}, {"k": 1}]')
    )
    return table(spark, folder, "events").select("event_id", body.alias("body"))


@register(
    "nested_shape",
    f"""WITH {NESTED_SQL} SELECT event_id, CASE event_type WHEN 'error' THEN 'MALFORMED' WHEN 'click' THEN 'KEY_REPEATED' WHEN 'signup' THEN 'KEY_REPEATED' ELSE 'OK' END AS verdict FROM t""",
)
def nested_shape(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated keys are refused at every depth, not at the top alone."""
    return _nested(spark, folder).select("event_id", jsontree.shape(F.col("body")).alias("verdict"))


@register(
    "nested_keys",
    f"""WITH {NESTED_SQL} SELECT event_id, CASE event_type WHEN 'click' THEN '/a/0/b' ELSE '' END AS parent, CASE event_type WHEN 'click' THEN 'k' ELSE 'x' END AS key, 2::BIGINT AS copies
FROM t WHERE event_type IN ('click', 'signup')""",
)
def nested_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Where the repeated keys are."""
    return jsontree.repeated_keys(_nested(spark, folder), "body", ["event_id"])


@register(
    "nested_parts",
    f"""WITH RECURSIVE {NESTED_SQL}, good AS (SELECT event_id, body::JSON AS j FROM t WHERE event_type NOT IN ('error', 'click', 'signup')),
parts AS (SELECT event_id, '' AS path, j, 0 AS depth FROM good
  UNION ALL SELECT event_id, path || '/' || key, value, depth + 1 FROM (SELECT p.event_id, p.path, p.depth, e.key, e.value FROM parts p, json_each(p.j) e WHERE json_type(p.j) IN ('OBJECT', 'ARRAY')))
SELECT event_id, path, depth, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind,
 CASE WHEN json_type(j) NOT IN ('OBJECT', 'ARRAY') THEN j::VARCHAR END AS value FROM parts""",
)
def nested_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Every part of the texts that are sound, with its pointer."""
    sound = _nested(spark, folder).filter(jsontree.shape(F.col("body")) == "OK")
    return jsontree.walk(sound, "body", ["event_id"]).select("event_id", "path", "depth", "kind", "value")


@register(
    "nested_redaction",
    """SELECT doc_id, '{"header":["Bearer [REDACTED] end",{"user":{"reset_token":"[REDACTED]","to":"mail [REDACTED_EMAIL], thanks"}}],"n":' || doc_id || '}' AS safe FROM documents""",
)
def nested_redaction(spark: SparkSession, folder: str) -> DataFrame:
    """Keys and texts below the top level of a payload are made safe too."""
    number = F.col("doc_id").cast("string")
    body = F.concat(
        F.lit('{"n": '), number, F.lit(', "header": ["bearer abc.'), number, F.lit(' end", {"user": {"to": "mail clerk'), number,
        F.lit('@mail.example.org, thanks", "reset_token": {"value": '), number, F.lit("}}}]}"),
    )
    return table(spark, folder, "documents").select("doc_id", jsontree.redact_json(body).alias("safe"))


@register("confidence_clamp", "SELECT event_id, GREATEST(0, LEAST(1, value / 250 - 0.2)) AS confidence FROM events")
def confidence_clamp(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", num.clamp_unit(F.col("value") / 250 - 0.2).alias("confidence")
    )


@register(
    "locator_contract",
    """WITH t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'attachment' WHEN 1 THEN 'body' ELSE 'subject' END AS kind, CASE WHEN length(html) % 2 = 0 THEN 'a' || page_id END AS attachment_id, CASE WHEN page_id % 5 = 0 THEN 1 END AS page,
  CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/abs/' || page_id WHEN 2 THEN 'a/../b' ELSE 'C:\\x' END AS ref FROM pages)
SELECT page_id, CASE WHEN kind = 'attachment' THEN attachment_id IS NOT NULL ELSE attachment_id IS NULL AND page IS NULL END AS locator_ok,
 page_id % 4 = 0 AS reference_ok, length(sha256(ref)) = 64 AS digest_ok FROM t""",
)
def locator_contract(spark: SparkSession, folder: str) -> DataFrame:
    page = F.col("page_id")
    source = F.struct(
        F.when(page % 3 == 0, "attachment").when(page % 3 == 1, "body").otherwise("subject").alias("kind"),
        F.when(F.length("html") % 2 == 0, F.concat(F.lit("a"), page.cast("string"))).alias("attachment_id"),
        F.when(page % 5 == 0, 1).alias("page"), F.lit(None).cast("int").alias("slide"),
        F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("string").alias("cell"),
    )
    ref = (
        F.when(page % 4 == 0, F.col("url")).when(page % 4 == 1, F.concat(F.lit("/abs/"), page.cast("string")))
        .when(page % 4 == 2, "a/../b").otherwise("C:\\x")
    )
    df = table(spark, folder, "pages").select("page_id", source.alias("source"), ref.alias("ref"))
    return df.select(
        "page_id", contracts.locator_consistent("source").alias("locator_ok"),
        contracts.opaque_reference(F.col("ref")).alias("reference_ok"), F.sha2("ref", 256).rlike(DIGEST_PATTERN).alias("digest_ok"),
    )
