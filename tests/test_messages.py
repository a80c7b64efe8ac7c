import hashlib
import os
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridlark.functions.hashing import GENESIS
from gridlark.plans import q_messages
from gridlark.operators import admission, attachments, audit, kpi, messages, ordered, orders, review
from gridlark.session import materialize


def test_running_totals_across_blocks(spark):
    rng = random.Random(3)
    rows = [("hot", p, rng.randint(1, 9)) for p in range(400)] + [("cold", p, 1) for p in (0, 77, 5000)]
    df = spark.createDataFrame(rows, "k string, p bigint, v bigint")
    got = {(r.k, r.p): r.t for r in ordered.running_total(df, ["k"], "p", {"t": "v"}, block=7).collect()}
    for key in ("hot", "cold"):
        total = 0
        for k, p, v in sorted(r for r in rows if r[0] == key):
            total += v
            assert got[k, p] == total


def test_numbers_are_dense_and_ordered(spark):
    rows = [(i % 3, (i * 37) % 101) for i in range(101)]
    df = spark.createDataFrame(rows, "g int, x int")
    got = sorted((r.x, r.n) for r in ordered.number_rows(df, ["x"], "n").collect())
    assert got == [(x, x + 1) for x in range(101)]
    within = defaultdict(list)
    for r in ordered.number_within(df, ["g"], ["x"], "n").collect():
        within[r.g].append((r.x, r.n))
    for pairs in within.values():
        assert [n for _, n in sorted(pairs)] == list(range(1, len(pairs) + 1))


def test_stored_tables_do_not_multiply_their_estimates(spark):
    """A loop of joins, as stock admission runs it, plans with sizes that do not grow with the rounds."""
    held = materialize(spark.range(50).withColumnRenamed("id", "k"))
    for _ in range(6):
        held = materialize(held.join(held.select("k"), "k"))
    assert held.count() == 50
    assert int(held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1_000_000


def test_dedup_keeps_the_first_content_and_flags_changes(spark):
    rows = [("m", "1", 1, "2025-01-01", "x"), ("m", "1", 2, "2025-01-02", "x"), ("m", "1", 3, "2025-01-03", "y"), ("m", "2", 4, "2025-01-01", "z")]
    df = spark.createDataFrame(rows, "mailbox_id string, provider_message_id string, delivery_id int, received_at string, content_digest string")
    jobs = {r.provider_message_id: r for r in messages.reserve(df).collect()}
    assert (jobs["1"].content_digest, jobs["1"].delivery_count, jobs["1"].conflict_count) == ("x", 3, 1)
    assert jobs["1"].reason_codes == ["MESSAGE_ID_CONTENT_CONFLICT"] and jobs["2"].reason_codes == []
    assert [r.delivery_id for r in messages.conflicts(df).collect()] == [3]
    assert jobs["1"].idempotency_key != jobs["2"].idempotency_key


# An own catalog: price and stock follow from the number; three articles are unusable in one way each.
ARTICLES = {f"pipe-{n}": (Decimal(40 * n) / 4, "EUR", 6 * n, "spring") for n in range(1, 5)}
ARTICLES |= {
    "crane-1": (Decimal(20000), "EUR", 9, "spring"), "valve-x": (Decimal(7), "CHF", 50, "spring"),
    "valve-y": (None, "EUR", 50, "spring"), "valve-z": (Decimal(7), "EUR", 50, "autumn"),
}


def policy(spark, headers, lines):
    heads = spark.createDataFrame(headers, "order_key string, detected_language string, ambiguities int, warnings int")
    raw = spark.createDataFrame(lines, "order_key string, sku string, quantity_text string, quote string, evidence_count int")
    items = raw.withColumns(
        {"quantity": F.col("quantity_text").try_cast("decimal(18,4)"), "quoted_unit_price": F.col("quote").try_cast("decimal(18,4)")}
    )
    rows = [(sku, *article) for sku, article in ARTICLES.items()]
    catalog = spark.createDataFrame(rows, "sku string, unit_price decimal(18,4), currency string, stock_qty int, catalog_version string")
    return {r.order_key: r for r in orders.order_policy(heads, items, catalog).collect()}


def expected_codes(sku, quantity, quote, evidence):
    """Codes of an order of one line, rule by rule."""
    codes = {"MISSING_LINE_EVIDENCE"} if not evidence else set()
    number = None if quantity in (None, "nan", "-Infinity") else Decimal(quantity)
    if not sku:
        return codes | {"MISSING_SKU"}
    if quantity in ("nan", "-Infinity"):
        return codes | {"NONFINITE_QUANTITY"}
    if number is None:
        return codes | {"MISSING_QUANTITY"}
    if number <= 0:
        return codes | {"NONPOSITIVE_QUANTITY"}
    if number % 1:
        return codes | {"FRACTIONAL_QUANTITY"}
    asked = None if quote is None else Decimal(quote)
    if asked is not None and asked <= 0:
        codes.add("INVALID_QUOTED_PRICE")
    if sku not in ARTICLES:
        return codes | {"UNKNOWN_SKU"}
    price, currency, stock, _ = ARTICLES[sku]
    if price is None:
        return codes | {"INVALID_CATALOG_PRICE"}
    if currency != "EUR":
        return codes | {"CURRENCY_MISMATCH"}
    if number > stock:
        codes.add("INSUFFICIENT_AGGREGATE_STOCK")
    if asked is not None and asked > 0 and abs(asked - price) > price * Decimal("0.02"):
        codes.add("QUOTED_PRICE_MISMATCH")
    if price * number > 50000:
        codes.add("HIGH_VALUE_REVIEW")
    return codes


def test_policy_over_a_grid_of_boundary_values(spark):
    cases = {}
    for sku in ("pipe-1", "pipe-4", "crane-1", "valve-x", "valve-y", "nowhere", None, ""):
        price, _, stock, _ = ARTICLES.get(sku, (None, "", 3, ""))
        for quantity in (None, "nan", "-Infinity", "-2", "0", "0.25", "1", str(stock), str(stock + 1)):
            for quote in (None, "0", *([] if price is None else [str(price * Decimal(f)) for f in ("0.98", "0.9799", "1", "1.02", "1.0201")])):
                for evidence in (0, 2):
                    cases[f"c{len(cases)}"] = (sku, quantity, quote, evidence)
    got = policy(spark, [(key, "eng", 0, 0) for key in cases], [(key, *case) for key, case in cases.items()])
    assert len(got) == len(cases)
    for key, case in cases.items():
        wanted = expected_codes(*case)
        # An order without a usable line and without another code is incomplete; here a code always says why.
        assert set(got[key].codes) == wanted and got[key].approved == (not wanted), case
        if not wanted:
            assert got[key].total == ARTICLES[case[0]][0] * Decimal(case[1])


def test_policy_of_headers_and_several_lines(spark):
    good = ("pipe-2", "3", None, 1)
    cases = {
        "dutch": (("nl", 0, 0), [good], ["UNSUPPORTED_LANGUAGE"]), "spaced": ((" German ", 0, 0), [good], []),
        "unsure": (("en", 2, 0), [good], ["UNRESOLVED_AMBIGUITY"]), "warned": (("de", 0, 1), [good], ["EXTRACTION_WARNING"]),
        "bare": (("en", 0, 0), [], ["NO_ORDER_LINES"]),
        "split stock": (("en", 0, 0), [("pipe-1", "4", None, 1), ("pipe-1", "3", None, 1)], ["INSUFFICIENT_AGGREGATE_STOCK"]),
        "split fits": (("en", 0, 0), [("pipe-1", "4", None, 1), ("pipe-1", "2", None, 1)], []),
        "two quotes": (("en", 0, 0), [("pipe-4", "1", "40.1", 1), ("pipe-4", "1", "40.2", 1)], ["SOURCE_PRICE_CONFLICT"]),
        "two versions": (("en", 0, 0), [good, ("valve-z", "1", None, 1)], ["CATALOG_VERSION_CONFLICT"]),
        "sum too high": (("en", 0, 0), [("crane-1", "2", None, 1), ("crane-1", "1", None, 1)], ["HIGH_VALUE_REVIEW"]),
    }
    got = policy(spark, [(key, *head) for key, (head, _, _) in cases.items()], [(key, *item) for key, (_, items, _) in cases.items() for item in items])
    assert {key: r.codes for key, r in got.items()} == {key: codes for key, (_, _, codes) in cases.items()}


def test_a_long_conversation_is_a_code_and_not_a_missing_row(spark):
    turns = [("long", t, f"turn {t}") for t in range(14)] + [("short", t, f"turn {t}") for t in range(3)]
    got = {r.conv_id: r for r in q_messages.compose_conversations(spark.createDataFrame(turns, "conv_id string, turn bigint, text string")).collect()}
    assert got["long"].limit_code == "ATTACHMENT_COUNT_LIMIT" and got["long"].digest is None
    whole = "SUBJECT:\nConversation short\n\nBODY:\nturn 0\n\nATTACHMENT 1:\nturn 1\n\nATTACHMENT 2:\nturn 2"
    assert got["short"].limit_code is None and got["short"].digest == hashlib.sha256(whole.encode()).hexdigest()


def test_assembled_texts_of_all_documents(spark):
    rows = [("fits", 2, " b "), ("fits", 1, "a"), ("fits", 3, "  "), ("over", 1, "x" * 9), ("over", 2, "yy"), ("blank", 1, "  ")]
    got = {r.attachment_id: (r.text, r.limit_code) for r in attachments.assemble_text(spark.createDataFrame(rows, "attachment_id string, pos int, text string"), 10).collect()}
    assert got == {"fits": ("a\nb", None), "over": (None, "CHARACTER_BUDGET_LIMIT"), "blank": (None, "EMPTY_DOCUMENT")}


def test_tool_budget_with_a_turn_of_1500_calls(spark):
    rows = [("c", 0, p, 1) for p in range(1500)] + [("c", 1, p, 1) for p in range(5)]
    lines = spark.createDataFrame(rows, "conversation_id string, turn int, pos int, characters int")
    calls = ordered.number_within(lines, ["conversation_id"], ["turn", "pos"], "position").drop("pos")
    got = kpi.tool_budget(calls, max_calls=1502, max_characters=10**6, max_turns=9).collect()
    assert [(r.position, r.code, r.calls) for r in got] == [(1503, "TOOL_CALL_BUDGET", 1503)]


def sequential_admission(attempts, lines, stock):
    left, won, out = dict(stock), {}, {}
    for attempt, _, key, digest in sorted(attempts, key=lambda a: a[1]):
        if key in won:
            out[attempt] = "duplicate" if won[key] == digest else "conflict"
        elif all(q <= left.get(s, 0) for s, q in lines[attempt]):
            for s, q in lines[attempt]:
                left[s] -= q
            won[key], out[attempt] = digest, "accepted"
        else:
            out[attempt] = "insufficient"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_admission_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    attempts = [(i, i * 3 + 1, f"k{rng.randint(0, 60)}", rng.choice("ab")) for i in range(90)]
    lines = {}
    for i in range(90):
        wanted = {"hot"} | set(rng.sample(["a", "b", "c", "none"], rng.randint(0, 2))) if rng.random() < 0.5 else set(rng.sample("abc", rng.randint(1, 2)))
        lines[i] = [(s, rng.randint(1, 6)) for s in sorted(wanted)]
    stock = [("hot", 60), ("a", 40), ("b", 25), ("c", 90)]
    rows = [(i, s, q) for i, pairs in lines.items() for s, q in pairs]
    got = admission.admit(
        spark.createDataFrame(attempts, "attempt_id int, arrival bigint, idempotency_key string, payload_digest string"),
        spark.createDataFrame(rows, "attempt_id int, sku string, quantity bigint"),
        spark.createDataFrame(stock, "sku string, stock_qty bigint"),
    )
    assert {r.attempt_id: r.decision for r in got.collect()} == sequential_admission(attempts, lines, stock)


def test_admission_with_one_sku_in_every_order(spark):
    """One scarce SKU ties all attempts together; others of theirs suffice for everybody."""
    rng = random.Random(9)
    attempts = [(i, i, f"k{i // 2 if i % 10 == 1 else i}", "ab"[i % 3 == 0]) for i in range(60)]
    lines = {i: [("every", rng.randint(1, 5)), (f"own{i % 7}", 1)] for i in range(60)}
    stock = [("every", 70), *[(f"own{j}", 100) for j in range(7)]]
    rounds: list[int] = []
    got = admission.admit(
        spark.createDataFrame(attempts, "attempt_id int, arrival bigint, idempotency_key string, payload_digest string"),
        spark.createDataFrame([(i, s, q) for i, pairs in lines.items() for s, q in pairs], "attempt_id int, sku string, quantity bigint"),
        spark.createDataFrame(stock, "sku string, stock_qty bigint"), rounds,
    )
    assert {r.attempt_id: r.decision for r in got.collect()} == sequential_admission(attempts, lines, stock)
    assert rounds[-1] == 0 and rounds == sorted(rounds, reverse=True) and len(rounds) < 20


def test_admission_leaves_only_decisions_on_disk(spark):
    """Many rounds over one SKU with colliding keys: of all tables only those with decisions are left."""
    from gridlark.session import shared_dir

    places = lambda: {p for p in os.listdir(shared_dir(spark)) if p.startswith("gridlark-")}
    before, rounds = places(), []
    attempts = spark.range(40).select(
        F.concat(F.lit("a"), "id").alias("attempt_id"), F.col("id").alias("arrival"), F.concat(F.lit("k"), F.col("id") % 9).alias("idempotency_key"), F.lit("d").alias("payload_digest")
    )
    lines = attempts.select("attempt_id", F.lit("s").alias("sku"), (F.col("arrival") * 7 % 5 + 1).alias("quantity"))
    got = admission.admit(attempts, lines, spark.createDataFrame([("s", 11)], "sku string, stock_qty long"), rounds)
    assert got.count() == 40 and len(rounds) > 1
    new = places() - before
    assert len(new) == len(rounds) + 1
    assert all("quantity" not in spark.read.parquet(f"{shared_dir(spark)}/{p}").columns for p in new)


def test_admission_settles_independent_attempts_at_once(spark):
    attempts = [(i, i, f"k{i}", "a") for i in range(40)]
    rounds: list[int] = []
    got = admission.admit(
        spark.createDataFrame(attempts, "attempt_id int, arrival bigint, idempotency_key string, payload_digest string"),
        spark.createDataFrame([(i, f"s{i % 20}", 2) for i in range(40)], "attempt_id int, sku string, quantity bigint"),
        spark.createDataFrame([(f"s{j}", 3 + j % 2) for j in range(20)], "sku string, stock_qty bigint"), rounds,
    )
    assert len(rounds) <= 2 and got.filter("decision = 'accepted'").count() == 30


def test_search_is_literal_and_limited(spark):
    catalog = spark.createDataFrame(
        [(f"S{i:03d}", "Red 50%_Beam", Decimal("1.0000"), "EUR", 1, i != 2) for i in range(9)] + [("X_1", "Blue", Decimal("2.0000"), "EUR", 1, True)],
        "sku string, name string, unit_price decimal(18,4), currency string, stock_qty int, active boolean",
    )
    asked = spark.createDataFrame([("50%_b",), ("%%%",), ("x_1",), ("ed",), ("RED ",)], "query string")
    got = defaultdict(list)
    for r in orders.catalog_search(asked, catalog).collect():
        got[r.query].append((r.place, r.sku))
    assert [s for _, s in sorted(got["50%_b"])] == ["S000", "S001", "S003", "S004", "S005"]
    assert got["x_1"] == [(1, "X_1")] and not got["%%%"] and not got["ed"] and len(got["RED "]) == 5


def test_search_meets_matching_pairs_only(spark):
    skus = [str(n) for n in range(100_000, 101_500)]
    names = ["Customer#%09d" % n for n in range(300)]
    catalog = spark.createDataFrame(
        [(s, names[i % 300], Decimal("1.0000"), "EUR", 1, True) for i, s in enumerate(skus)],
        "sku string, name string, unit_price decimal(18,4), currency string, stock_qty int, active boolean",
    )
    wanted = skus[::2] + ["0100", "999999"] + [n.upper() for n in names[::3]] + ["customer#00000012"]
    got = orders.catalog_search(spark.createDataFrame([(w,) for w in wanted], "query string"), catalog)
    found = defaultdict(list)
    for r in got.collect():
        found[r.query].append((r.place, r.sku))
    for query in wanted:
        hits = sorted(s for i, s in enumerate(skus) if query.lower() in s or query.lower() in names[i % 300].lower())[:5]
        assert sorted(found.get(query, [])) == list(enumerate(hits, 1)), query

    def joined(node):
        """Rows out of each join below the node."""
        name, metrics = node.nodeName(), node.metrics()
        if "Join" in name:
            yield metrics.apply("numOutputRows").value()
        below = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else []
        children = node.children()
        for child in below + [children.apply(i) for i in range(children.size())]:
            yield from joined(child)

    assert max(joined(got._jdf.queryExecution().executedPlan())) <= 4 * len(wanted)


def test_chain_builds_verifies_and_locates_damage(spark):
    rows = [("hot", i, f"{i:064x}") for i in range(1, 301)] + [("b", 1, "f" * 64), ("c", 1, "e" * 64), ("c", 2, "d" * 64)]
    events = spark.createDataFrame(rows, "trace_id string, sequence bigint, content_digest string")
    chain = audit.build_chain(events)
    full = events.join(chain, ["trace_id", "sequence"])
    assert {r.trace_id for r in audit.verify_traces(full).collect() if r.verified} == {"hot", "b", "c"}
    assert full.filter("sequence = 1 and previous_hash != '%s'" % GENESIS).isEmpty()
    damaged = full.filter("not (trace_id = 'c' and sequence = 1)").withColumn(
        "content_digest", F.when((F.col("trace_id") == "hot") & (F.col("sequence") == 150), "0" * 64).otherwise(F.col("content_digest"))
    )
    got = {r.trace_id: (r.verified, r.first_break, r.break_code) for r in audit.verify_traces(damaged).collect()}
    assert got == {"hot": (False, 150, "EVENT_HASH"), "b": (True, None, None), "c": (False, 2, "SEQUENCE_GAP")}
    more = spark.createDataFrame([("b", 2, "a" * 64)], "trace_id string, sequence bigint, content_digest string")
    grown = full.unionByName(more.join(audit.build_chain(more, audit.chain_heads(full)), ["trace_id", "sequence"]))
    assert audit.verify_traces(grown).filter("not verified").isEmpty()


def test_chain_is_whole_when_the_plan_changes_while_it_runs(spark):
    """Traces cut by a range partition, whose join turns into a broadcast while the query runs."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        events = spark.range(20_000).select((F.col("id") % 7).alias("trace_id"), F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        log = audit.with_sequence(events.withColumn("payload", F.repeat("pad", 20)), ("event_id",))
        got = audit.build_chain(log.withColumn("content_digest", F.sha2("payload", 256))).collect()
    finally:
        spark.conf.set(name, before)
    assert len(got) == 20_000
    by = {(r.trace_id, r.sequence): r for r in got}
    for (trace, place), row in by.items():
        assert row.previous_hash == (by[trace, place - 1].event_hash if place > 1 else GENESIS)


def test_review_path_and_refusals(spark):
    path = [("PENDING", "w", "SYSTEM"), ("CLAIMED", "ann", "ORDER_REVIEWER"), ("CORRECTED", "ann", "ORDER_REVIEWER"),
            ("REVALIDATED", "ann", "ORDER_REVIEWER"), ("WRITE_PENDING", "ann", "ORDER_REVIEWER"), ("ERP_CREATED", "w", "SYSTEM"),
            ("APPROVED", "ann", "ORDER_REVIEWER")]
    rows = [("good", "order", i + 1, *step) for i, step in enumerate(path)]
    rows += [("thief", "order", i + 1, s, "bob" if i == 2 else a, r) for i, (s, a, r) in enumerate(path[:3])]
    rows += [("skip", "order", 1, *path[0]), ("skip", "order", 2, *path[3])]
    rows += [("role", "security", 1, *path[0]), ("role", "security", 2, *path[1])]
    rows += [("gap", "order", 1, *path[0]), ("gap", "order", 3, *path[1])]
    df = spark.createDataFrame(rows, "review_id string, review_type string, version int, state string, actor_id string, actor_role string")
    bad = {(r.review_id, r.version): r.code for r in review.check_transitions(df).collect() if r.code}
    assert bad == {("thief", 3): "NOT_OWNER", ("skip", 2): "ILLEGAL_TRANSITION", ("role", 2): "ROLE_REQUIRED", ("gap", 3): "VERSION_GAP"}
    assert {r.review_id: r.state for r in review.latest(df).collect()}["good"] == "APPROVED"
    assert [(r.review_id, r.code) for r in review.version_conflicts(df).collect()] == [("gap", "VERSION_GAP")]


def test_filename_and_attachment_rules(spark):
    names = ["a.pdf", "../a.pdf", "a.exe", ".pdf", "", "x/y.xlsx", "B.PPTX", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(attachments.filename_code(F.col("n")).alias("c"))
    assert [r.c for r in df.collect()] == [
        None, "UNSAFE_FILENAME", "UNSUPPORTED_ATTACHMENT", "UNSUPPORTED_ATTACHMENT", "UNSAFE_FILENAME", "UNSAFE_FILENAME", None, "UNSAFE_FILENAME",
    ]


def test_gate_and_value_case(spark):
    assert kpi.required_sample(0.01, 0.95) == 299
    bounds = spark.range(298, 300).select(kpi.defect_bound(F.col("id")).alias("b")).collect()
    assert bounds[0].b > 0.01 > bounds[1].b
    with pytest.raises(ValueError):
        kpi.required_sample(0, 0.95)
    values = dict(
        annual_volume=12000.0, current_minutes=12.0, labor_cost_per_hour=48.0, auto_share=0.55, escalation_share=0.4, blocked_share=0.05,
        escalation_minutes=6.25, security_minutes=5.0, screening_cost=0.02, extraction_cost=0.1, infrastructure_cost=0.04,
        fixed_annual_cost=24000.0, one_time_cost=70000.0, ramp_months=6.0, current_rework_share=0.04, current_rework_minutes=10.0,
    )
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0.5).alias("cash_realization_share"))
    row = kpi.value_scenarios(df).first()
    assert row.valid and row.current_hours == pytest.approx(2480) and row.current_cost == pytest.approx(119040)
    assert row.review_hours == pytest.approx(550) and row.released_hours == pytest.approx(1930)
    assert row.cash_benefit == pytest.approx(46320) and row.net_benefit == pytest.approx(20400)
    assert row.payback_months == pytest.approx(44.176, abs=0.01)
    bad = kpi.value_scenarios(df.withColumn("auto_share", F.lit(0.6))).first()
    assert not bad.valid and bad.errors == ["shares:SUM"] and bad.current_hours is None


def test_first_breach_ends_a_run(spark):
    rows = [("a", i, 1, 100) for i in range(12)] + [("b", 0, 1, 11_999), ("b", 1, 2, 1), ("b", 2, 2, 1)] + [("c", 0, 7, 1)]
    df = spark.createDataFrame(rows, "conversation_id string, position bigint, turn int, characters bigint")
    got = {r.conversation_id: (r.position, r.code) for r in kpi.tool_budget(df).collect()}
    assert got == {"a": (8, "TOOL_CALL_BUDGET"), "b": (2, "TOOL_OUTPUT_BUDGET"), "c": (0, "MODEL_TURN_BUDGET")}
