"""Order policy, totals, catalog checks, search, history and numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlark.functions.numeric import MONEY
from gridlark.operators.ordered import number_rows

# Fixed values.
SUPPORTED_LANGUAGES = ("en", "eng", "english", "de", "deu", "ger", "german", "deutsch")
PRICE_TOLERANCE = "0.02"
MAX_ORDER_VALUE = "50000"
SEARCH_LIMIT = 5
SEARCH_MIN_LENGTH = 3
SEARCH_WHOLE = 8  # longest query that is looked up as one piece
HISTORY_LIMIT = 5


def supported_language(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*SUPPORTED_LANGUAGES), F.lit(False))


def line_code(sku: Column, quantity: Column, quantity_text: Column) -> Column:
    """Why a line cannot be counted, NULL when it can; one reason per line.

    ``quantity_text`` is the raw text: a non-finite number has no exact decimal.
    """
    odd = F.coalesce(F.lower(F.trim(quantity_text)).rlike(r"^[+-]?(nan|inf|infinity)$"), F.lit(False))
    return (
        F.when(sku.isNull() | (sku == ""), "MISSING_SKU")
        .when(odd, "NONFINITE_QUANTITY")
        .when(quantity.isNull(), "MISSING_QUANTITY")
        .when(quantity <= 0, "NONPOSITIVE_QUANTITY")
        .when(quantity != F.floor(quantity), "FRACTIONAL_QUANTITY")
    )


def explode_lines(orders: DataFrame, lines: str = "lines") -> DataFrame:
    """Nested order lines as rows with their index and field path."""
    flat = orders.select("*", F.posexplode(lines).alias("line_index", "line")).drop(lines)
    return flat.withColumn("field_path", F.concat(F.lit("lines."), F.col("line_index").cast("string")))


def check_lines(lines: DataFrame) -> DataFrame:
    """Line-level codes; ``evidence_count`` holds the number of evidence entries."""
    code = line_code(F.col("sku"), F.col("quantity"), F.col("quantity_text"))
    quote = F.col("quoted_unit_price")
    return lines.withColumn("code", code).withColumns(
        {
            "evidence_code": F.when(F.coalesce("evidence_count", F.lit(0)) == 0, "MISSING_LINE_EVIDENCE"),
            "quote_code": F.when(F.col("code").isNull() & (quote <= 0), "INVALID_QUOTED_PRICE"),
        }
    )


def order_lines(checked: DataFrame, by: Sequence[str] = ("order_key",)) -> DataFrame:
    """Accepted lines summed per order and SKU, with the spread of quoted prices.

    Refused lines enter as nothing instead of being filtered first: a filter on
    the code would be pushed below the lines and evaluate their rules twice.
    """
    counts = F.col("code").isNull()
    quote = F.when(counts & (F.col("quoted_unit_price") > 0), F.col("quoted_unit_price"))
    grouped = checked.groupBy(*by, "sku").agg(
        F.count_if(counts).alias("_n"),
        F.sum(F.when(counts, F.col("quantity").cast("bigint"))).alias("quantity"),
        F.min(quote).alias("quote_low"),
        F.max(quote).alias("quote_high"),
    )
    return grouped.filter("_n > 0").drop("_n")


def price_lines(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Order lines with their catalog row and catalog-level code.

    Two distinct quotes exist exactly when the lowest and highest differ, and
    some quote leaves the tolerance exactly when the lowest or the highest does,
    so the set of quotes need not be kept.
    """
    joined = lines.join(catalog, "sku", "left")
    price = F.col("unit_price")
    known = F.col("catalog_version").isNotNull()
    code = (
        F.when(~known, "UNKNOWN_SKU")
        .when(price.isNull() | (price <= 0), "INVALID_CATALOG_PRICE")
        .when(F.coalesce(F.col("currency"), F.lit("")) != "EUR", "CURRENCY_MISMATCH")
    )
    gap = lambda q: F.abs(F.col(q) - price) > price * F.lit(PRICE_TOLERANCE).cast("decimal(4,2)")
    return joined.withColumn("catalog_code", code).withColumns(
        {
            "stock_code": F.when(
                F.col("catalog_code").isNull() & (F.col("quantity") > F.col("stock_qty")), "INSUFFICIENT_AGGREGATE_STOCK"
            ),
            "conflict_code": F.when(
                F.col("catalog_code").isNull() & (F.col("quote_low") < F.col("quote_high")), "SOURCE_PRICE_CONFLICT"
            ),
            "mismatch_code": F.when(
                F.col("catalog_code").isNull() & (gap("quote_low") | gap("quote_high")), "QUOTED_PRICE_MISMATCH"
            ),
        }
    )


def order_totals(priced: DataFrame, by: Sequence[str] = ("order_key",)) -> DataFrame:
    """Exact total, catalog version spread and number of usable lines per order."""
    usable = F.col("catalog_code").isNull()
    amount = F.when(usable, F.col("unit_price").cast(MONEY) * F.col("quantity").cast("decimal(18,0)"))
    version = F.when(usable, F.col("catalog_version"))
    return priced.groupBy(*by).agg(
        F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(38,4)").alias("total"),
        F.count_if(usable).alias("usable_lines"),
        F.min(version).alias("_vlow"),
        F.max(version).alias("catalog_version"),
    ).withColumn(
        "version_code", F.when(F.col("_vlow") < F.col("catalog_version"), "CATALOG_VERSION_CONFLICT")
    ).drop("_vlow")


def _flags(df: DataFrame, by: Sequence[str], columns: Sequence[str], prefix: str) -> DataFrame:
    """Distinct codes per order from several nullable code columns.

    Codes come from a fixed vocabulary, so the set is small.
    """
    codes = F.array_compact(F.array(*[F.col(c) for c in columns]))
    return df.select(*by, F.explode(codes).alias("_c")).groupBy(*by).agg(F.collect_set("_c").alias(prefix))


def order_policy(orders: DataFrame, lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """All policy codes of each order, sorted, and whether it is approved.

    ``orders``: order_key, detected_language, ambiguities, warnings (counts).
    ``lines``: order_key, sku, quantity, quantity_text, quoted_unit_price, evidence_count.
    """
    by = ["order_key"]
    checked = check_lines(lines)
    per_line = _flags(checked, by, ("code", "evidence_code", "quote_code"), "_line")
    priced = price_lines(order_lines(checked), catalog)
    per_sku = _flags(priced, by, ("catalog_code", "stock_code", "conflict_code", "mismatch_code"), "_sku")
    totals = order_totals(priced)
    present = lines.groupBy(*by).agg(F.count(F.lit(1)).alias("_lines"))
    empty = F.array().cast("array<string>")
    joined = (
        orders.join(present, by, "left").join(per_line, by, "left").join(per_sku, by, "left").join(totals, by, "left")
    )
    own = F.array_compact(
        F.array(
            F.when(~supported_language(F.col("detected_language")), "UNSUPPORTED_LANGUAGE"),
            F.when(F.col("_lines").isNull(), "NO_ORDER_LINES"),
            F.when(F.col("ambiguities") > 0, "UNRESOLVED_AMBIGUITY"),
            F.when(F.col("warnings") > 0, "EXTRACTION_WARNING"),
            F.col("version_code"),
            F.when(F.col("total") > F.lit(MAX_ORDER_VALUE).cast("decimal(38,4)"), "HIGH_VALUE_REVIEW"),
        )
    )
    codes = F.concat(own, F.coalesce("_line", empty), F.coalesce("_sku", empty))
    incomplete = (F.size(codes) == 0) & (F.coalesce("usable_lines", F.lit(0)) == 0)
    codes = F.when(incomplete, F.array(F.lit("VALIDATION_INCOMPLETE"))).otherwise(F.array_sort(codes))
    return joined.select(
        *by, codes.alias("codes"), F.coalesce("total", F.lit(0).cast("decimal(38,4)")).alias("total"), "catalog_version"
    ).withColumn("approved", F.size("codes") == 0)


def total_matches(commands: DataFrame, lines: DataFrame, by: Sequence[str] = ("order_key",)) -> DataFrame:
    """Commands whose stated total is not the exact sum of price times quantity."""
    amount = F.col("unit_price").cast(MONEY) * F.col("quantity").cast("decimal(18,0)")
    sums = lines.groupBy(*by).agg(F.sum(amount).cast("decimal(38,4)").alias("line_total"))
    return commands.join(sums, list(by), "left").withColumn(
        "total_matches", F.coalesce(F.col("total").cast("decimal(38,4)") == F.col("line_total"), F.lit(False))
    )


def catalog_recheck(
    orders: DataFrame, lines: DataFrame, catalog: DataFrame, customers: DataFrame, live_version: Column
) -> DataFrame:
    """Reasons an approved order no longer fits the live catalog, in fixed order.

    ``orders``: order_key, customer_id, catalog_version, total.
    ``lines``: order_key, sku, quantity, unit_price.
    """
    live = catalog.filter("active").select(
        "sku", F.col("unit_price").alias("_price"), F.col("currency").alias("_currency"), F.col("stock_qty").alias("_stock")
    )
    grouped = lines.groupBy("order_key", "sku").agg(
        F.sum("quantity").alias("quantity"), F.min("unit_price").alias("_lo"), F.max("unit_price").alias("_hi")
    )
    seen = grouped.join(live, "sku", "left")
    gone = F.col("_price").isNull()
    changed = ~gone & ((F.col("_currency") != "EUR") | (F.col("_lo") != F.col("_price")))
    amount = F.col("_price").cast(MONEY) * F.col("quantity").cast("decimal(18,0)")
    per_order = seen.groupBy("order_key").agg(
        F.count_if(F.col("_lo") < F.col("_hi")).alias("_split"),
        F.count_if(gone).alias("_gone"),
        F.count_if(changed).alias("_changed"),
        F.count_if(~gone & (F.col("quantity") > F.col("_stock"))).alias("_short"),
        F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(38,4)").alias("live_total"),
    )
    active = customers.filter("active").select("customer_id", F.lit(True).alias("_active"))
    joined = orders.join(per_order, "order_key", "left").join(active, "customer_id", "left")
    codes = F.array_compact(
        F.array(
            F.when(F.col("_active").isNull(), "CUSTOMER_UNAVAILABLE"),
            F.when(F.col("catalog_version") != live_version, "CATALOG_VERSION_STALE"),
            F.when(F.col("_split") > 0, "CONFLICTING_LINE_PRICES"),
            F.when(F.col("_gone") > 0, "PRODUCT_UNAVAILABLE"),
            F.when(F.col("_changed") > 0, "PRICE_OR_CURRENCY_CHANGED"),
            F.when(F.col("_short") > 0, "INSUFFICIENT_STOCK"),
            F.when(
                ~F.coalesce(F.col("total").cast("decimal(38,4)") == F.col("live_total"), F.lit(False)), "TOTAL_CHANGED"
            ),
        )
    )
    return joined.select("order_key", "customer_id", "live_total", codes.alias("codes"))


def _pieces(text: Column, size: Column) -> Column:
    """Distinct pieces of a text of one length."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, size))))


def _cut(texts: DataFrame, asked: DataFrame, piece: str) -> DataFrame:
    """The texts with each of their pieces that has a length queries are found by: a handful of lengths."""
    sizes = asked.agg(F.collect_set("_n").alias("s")).scalar()
    sized = texts.withColumn("_sizes", sizes).withColumn("_n", F.explode("_sizes"))
    return sized.select(*texts.columns, F.explode(_pieces(F.col("_text"), F.col("_n"))).alias(piece))


def catalog_search(queries: DataFrame, catalog: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """First SKUs, in SKU order, whose name or SKU contains the query text.

    A query of up to SEARCH_WHOLE characters is itself a piece of every text that
    contains it: an equi-join on pieces of its length finds exactly its texts, and
    a piece keeps its first few SKUs before it meets the query.  A longer query
    meets the texts that share its rarest piece, of the largest power of two that
    fits, and these are verified.  So pairs that do not match stay few, however
    many queries and products there are.  Names shared by many products carry
    only their first few SKUs: no more can ever be shown.
    """
    size = F.length("_q")
    asked = queries.select("query").distinct().withColumn("_q", F.lower(F.trim("query"))).filter(size >= SEARCH_MIN_LENGTH)
    active = catalog.filter("active")
    by_name = (
        active.select(F.lower("name").alias("_text"), "sku")
        .groupBy("_text", "sku").agg(F.lit(1))
        .withColumn("_place", F.row_number().over(Window.partitionBy("_text").orderBy("sku")))
        .filter(F.col("_place") <= limit)
        .select("_text", "sku")
    )
    by_sku = active.select(F.lower("sku").alias("_text"), "sku")
    # Partitions that are not merged: a text becomes dozens of pieces, and a task sorts them.
    tasks = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("sku"), F.lit(8 * tasks))
    entries = by_name.unionByName(by_sku).withColumn("_bucket", bucket).repartition(tasks, "_bucket")

    def first(pieces: DataFrame, keys: list[str]) -> DataFrame:
        ranked = pieces.withColumn("place", F.dense_rank().over(Window.partitionBy(*keys).orderBy("sku")))
        return ranked.filter(F.col("place") <= limit)

    whole = asked.filter(size <= SEARCH_WHOLE).withColumn("_n", size)
    # First where the pieces are cut, so that no piece is hot in the shuffle.
    held = first(_cut(entries.select("_bucket", "_text", "sku"), whole, "_q"), ["_bucket", "_q"])
    kept = first(held.select("_q", "sku").repartition(tasks, "_q"), ["_q"]).distinct()
    short = whole.join(kept, "_q").select("query", "place", "sku")

    long = asked.filter(size > SEARCH_WHOLE).withColumn("_n", F.expr("shiftleft(1, length(bin(length(_q))) - 1)"))
    texts = entries.select("_text").distinct()
    grams = _cut(texts, long, "_gram")
    weight = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_w"))
    parts = long.select("query", "_q", F.explode(_pieces(F.col("_q"), F.col("_n"))).alias("_gram"))
    rarest = (
        parts.join(weight, "_gram", "left")
        .groupBy("query", "_q")
        .agg(F.min_by("_gram", F.struct(F.coalesce("_w", F.lit(0)).alias("w"), F.col("_gram").alias("g"))).alias("_gram"))
    )
    matched = rarest.join(grams, "_gram").filter(F.contains(F.col("_text"), F.col("_q"))).select("query", "_text")
    top = short.unionByName(first(matched.join(entries, "_text").select("query", "sku"), ["query"]).distinct().select(short.columns))
    shown = active.select("sku", "name", "unit_price", "currency", "stock_qty")
    return top.join(shown, "sku").select("query", "place", "sku", "name", "unit_price", "currency", "stock_qty")


def recent_orders(orders: DataFrame, customers: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest orders per active customer; ties by order id.  The top-k runs before the shuffle."""
    active = customers.filter("active").select("customer_id")
    newest = Window.partitionBy("customer_id").orderBy(F.desc("created_at"), F.desc("order_id"))
    return (
        orders.join(active, "customer_id", "left_semi")
        .withColumn("place", F.row_number().over(newest))
        .filter(F.col("place") <= limit)
        .select("customer_id", "place", "order_id", "total", "currency", "created_at")
    )


def order_numbers(orders: DataFrame, order: Sequence[str] = ("created_at", "order_key")) -> DataFrame:
    """Consecutive order ids in creation order."""
    numbered = number_rows(orders, order, "_n")
    digits = F.col("_n").cast("string")
    padded = F.when(F.col("_n") < 1_000_000, F.lpad(digits, 6, "0")).otherwise(digits)
    return numbered.withColumn("order_id", F.concat(F.lit("ORD-"), padded)).drop("_n")
