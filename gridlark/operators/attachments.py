"""Attachments and their fragments: metadata rules, limits, blocklists, assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridlark.operators.ordered import running_total

# Fixed values.
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
MAX_ATTACHMENTS = 10
MAX_BYTES = 10 * 1024 * 1024
MAX_TOTAL_BYTES = 25 * 1024 * 1024
MAX_PAGES = 50
MAX_SLIDES = 100
MAX_SHEETS = 10
MAX_ROWS_PER_SHEET = 5_000
MAX_CELLS = 50_000
MAX_CHARACTERS = 100_000
MAX_ENTRIES = 10_000
MAX_UNCOMPRESSED = 100 * 1024 * 1024
MAX_RATIO = 100.0


def stripped(text: Column) -> Column:
    """Text without outer white space of any kind."""
    return F.btrim(text, F.lit(" \t\r\n\f\u000b"))


def filename_code(name: Column) -> Column:
    """Reason an original file name is refused, NULL when acceptable."""
    suffix = F.lower(F.regexp_extract(name, r"(?s)[^.](\.[^.]*)$", 1))
    unsafe = (
        name.isNull() | (name == "") | F.contains(name, F.lit("\u0000")) | name.rlike(r"[/\\]") | name.isin(".", "..")
    )
    return F.when(unsafe, "UNSAFE_FILENAME").when(~suffix.isin(*MEDIA_TYPES), "UNSUPPORTED_ATTACHMENT")


def attachment_code(name: Column, size: Column, declared: Column, head: Column) -> Column:
    """First rule an attachment breaks: name, emptiness, size, type, signature."""
    suffix = F.lower(F.regexp_extract(name, r"(?s)[^.](\.[^.]*)$", 1))
    detected = F.lit(None).cast("string")
    for extension, media in MEDIA_TYPES.items():
        detected = F.when(suffix == extension, media).otherwise(detected)
    signature = F.when(suffix == ".pdf", head.startswith("%PDF-")).otherwise(head.startswith("PK"))
    return F.coalesce(
        filename_code(name),
        F.when(size == 0, "EMPTY_ATTACHMENT"),
        F.when(size > MAX_BYTES, "ATTACHMENT_TOO_LARGE"),
        F.when((declared != "") & (F.lower(declared) != detected), "MIME_MISMATCH"),
        F.when(~F.coalesce(signature, F.lit(False)), "WRONG_FILE_TYPE"),
    )


def message_limits(attachments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attachment count and total size per message with the specific code."""
    totals = attachments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attachments"), F.sum("byte_size").alias("total_bytes")
    )
    code = F.when(F.col("attachments") > MAX_ATTACHMENTS, "ATTACHMENT_COUNT_LIMIT").when(
        F.col("total_bytes") > MAX_TOTAL_BYTES, "TOTAL_ATTACHMENT_SIZE_LIMIT"
    )
    return totals.withColumn("limit_code", code)


def with_limit_code(df: DataFrame, attachments: DataFrame, by: Sequence[str]) -> DataFrame:
    """All rows, with the code of the limit that their message breaks, or NULL.

    Messages without a code have few attachments of bounded size, so only they may be assembled.
    """
    codes = message_limits(attachments, by).select(*by, "limit_code")
    return df.join(codes, list(by), "left")


def fragment_limits(
    fragments: DataFrame,
    pages: int = MAX_PAGES,
    slides: int = MAX_SLIDES,
    sheets: int = MAX_SHEETS,
    rows: int = MAX_ROWS_PER_SHEET,
    cells: int = MAX_CELLS,
) -> DataFrame:
    """Page, slide, sheet, row and cell counts per document and the first limit broken.

    Fragments collapse to (document, sheet, row, page, slide) before anything
    distinct is counted, so a huge document is counted in parallel.
    """
    place = ["attachment_id", "page", "slide", "sheet", "row"]
    cell = fragments.groupBy(*place).agg(
        F.count("cell").alias("cells"), F.sum(F.length(stripped(F.col("text")))).alias("characters")
    )
    sheet = cell.groupBy("attachment_id", "page", "slide", "sheet").agg(
        F.count("row").alias("rows"), F.sum("cells").alias("cells"), F.sum("characters").alias("characters")
    )
    doc = sheet.groupBy("attachment_id").agg(
        F.count_distinct("page").alias("pages"), F.count_distinct("slide").alias("slides"),
        F.count_distinct("sheet").alias("sheets"), F.max("rows").alias("max_rows"),
        F.sum("cells").alias("cells"), F.sum("characters").alias("characters"),
    )
    code = (
        F.when(F.col("pages") > pages, "PDF_PAGE_LIMIT")
        .when(F.col("slides") > slides, "PPTX_SLIDE_LIMIT")
        .when(F.col("sheets") > sheets, "XLSX_SHEET_LIMIT")
        .when(F.col("max_rows") > rows, "XLSX_ROW_LIMIT")
        .when(F.col("cells") > cells, "XLSX_CELL_LIMIT")
        .when(F.col("characters") == 0, "EMPTY_DOCUMENT")
    )
    return doc.withColumn("limit_code", code)


def container_limits(entries: DataFrame) -> DataFrame:
    """Entry count, expanded size, compression ratio and path safety per container."""
    unsafe = F.col("entry_name").startswith("/") | F.array_contains(F.split("entry_name", "/"), "..")
    out = entries.groupBy("attachment_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum("file_size").alias("uncompressed"),
        F.sum(F.greatest(F.col("compress_size"), F.lit(1))).alias("compressed"),
        F.count_if(unsafe).alias("unsafe_paths"),
    )
    ratio = F.col("uncompressed") / F.col("compressed")
    bomb = (F.col("entries") > MAX_ENTRIES) | (F.col("uncompressed") > MAX_UNCOMPRESSED) | (ratio > MAX_RATIO)
    code = F.when(bomb, "DECOMPRESSION_BOMB").when(F.col("unsafe_paths") > 0, "UNSAFE_CONTAINER_PATH")
    return out.withColumn("container_code", code)


def character_budget(fragments: DataFrame, limit: int = MAX_CHARACTERS) -> DataFrame:
    """Documents over the character budget and the fragment at which each breaks it.

    Blank fragments do not count.  Totals find the documents over budget; only
    their fragments get running sums, block by block.
    """
    sized = fragments.withColumn("_chars", F.length(stripped(F.col("text")))).filter("_chars > 0")
    over = sized.groupBy("attachment_id").agg(F.sum("_chars").alias("_total")).filter(F.col("_total") > limit)
    suspect = sized.select("attachment_id", "pos", "_chars").join(over.select("attachment_id"), "attachment_id", "left_semi")
    running = running_total(suspect, ["attachment_id"], "pos", {"running_characters": "_chars"})
    return running.filter(F.col("running_characters") > limit).groupBy("attachment_id").agg(
        F.min("pos").alias("first_over"), F.min("running_characters").alias("characters_at_breach")
    )


def assemble_text(fragments: DataFrame, limit: int = MAX_CHARACTERS) -> DataFrame:
    """One row per document: its fragments in order as one text, or the code why there is none.

    Only documents within the budget are gathered, so a text is bounded by it.
    """
    over = character_budget(fragments, limit).select("attachment_id", F.lit("CHARACTER_BUDGET_LIMIT").alias("_code"))
    marked = fragments.withColumn("text", stripped(F.col("text"))).join(over, "attachment_id", "left")
    kept = F.col("_code").isNull() & (F.col("text") != "")
    parts = F.array_sort(F.collect_list(F.when(kept, F.struct("pos", "text"))))
    out = marked.groupBy("attachment_id").agg(parts.alias("_parts"), F.max("_code").alias("_over"))
    code = F.coalesce("_over", F.when(F.size("_parts") == 0, "EMPTY_DOCUMENT"))
    text = F.array_join(F.transform("_parts", lambda p: p["text"]), "\n")
    return out.select("attachment_id", F.when(code.isNull(), text).alias("text"), code.alias("limit_code"))


def compose_content(subject: Column, body: Column, texts: Column) -> Column:
    """Screened content of a message: subject, body, then numbered attachments."""
    numbered = F.transform(
        texts, lambda t, i: F.concat(F.lit("ATTACHMENT "), (i + 1).cast("string"), F.lit(":\n"), t)
    )
    head = F.array(F.concat(F.lit("SUBJECT:\n"), subject), F.concat(F.lit("BODY:\n"), body))
    return F.array_join(F.concat(head, numbered), "\n\n")


def blocklist_hits(attachments: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Attachments named by id or digest; a scan timeout outranks an infection.

    The OR over two keys becomes two equi-joins.
    """
    listed = blocklist.select("key", "verdict")
    by_id = attachments.select("attachment_id", F.col("attachment_id").alias("key"))
    by_digest = attachments.select("attachment_id", F.col("digest").alias("key"))
    hits = by_id.unionByName(by_digest).join(listed, "key")
    timeout = F.bool_or(F.col("verdict") == "timeout")
    return hits.groupBy("attachment_id").agg(
        F.when(timeout, "MALWARE_SCAN_TIMEOUT").otherwise("MALWARE_DETECTED").alias("scan_code")
    )


def touches(keys: Column, blocked: Column) -> Column:
    """True where two small key sets meet."""
    return F.arrays_overlap(keys, blocked)
