"""Line quality rules: text measures and the frequency of lines across a host's documents.

Everything is a DataFrame expression. Texts are read once: the measures and
the hashes of the lines go to a narrow table, and the rest works on that.

* Hosts: the number of a host's documents that hold a normalized line is
  counted exactly. Each document contributes a line once, so a hot line or a
  hot host is one partial count in every task.
* A line is over the limit in a host if more than `least_docs` documents and
  more than `share` of the host's documents hold it. Such lines are removed.
* A document is depleted if it has less than `left` of its words left.

NULL texts have no words and fail. NULL hosts are one host. Every row is a
document, also a repeated one. An empty table gives an empty result.
Texts are taken whole, however long. Only the id, the text and the host are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import store

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, though body may name it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def removed(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that the list holds twice or more."""

    def windows(w: Column) -> Column:
        last = F.size(w) - WINDOW
        hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(*(w[i + j] for j in range(WINDOW))).alias("h"), i.alias("i")))
        return F.when(last > 0, let(F.sort_array(hashed), starts)).otherwise(F.lit(0))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h))
        # A comparison with nothing is NULL, which filter() takes as no.
        return let(F.sort_array(F.transform(twice, lambda x: x.i)), covered)

    def covered(p: Column) -> Column:
        own = F.transform(p, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda a, b: a + b)

    return let(words, windows).cast("long")


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, the measures, and lines array<struct<h, words>> of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    has_word = lambda line: F.length(removed(line, BLANK)) > 0
    normal = lambda line: F.lower(F.array_join(words_of(line), " "))
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    lined = F.filter(F.split("text", "\n", -1), has_word)
    return source.select(
        "doc_id", "host",
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(removed(F.col("text"), BLANK)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(removed(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        let(lined, lambda x: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.transform(x, lambda line: F.struct(F.xxhash64(normal(line)).alias("h"), F.size(words_of(line)).alias("words"))).alias("lines"),
        )).alias("l"),
    ).select("doc_id", "host", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.lines")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          least_docs: int = 20, share: float = 0.001, left: float = 0.3) -> DataFrame:
    """One row per document: the measures, base_failed, n_common_words (in removed lines), kept."""
    rows = store(measure(df, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()), "line-measures")
    same_host = lambda a, b: a.eqNullSafe(b)
    per_host = rows.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    held = (
        rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x.h))).alias("h"))
        .groupBy("host", "h").agg(F.count(F.lit(1)).alias("held"))
        .where(F.col("held") > least_docs)
    )
    p = per_host.select(F.col("host").alias("p_host"), "docs")
    common = (
        held.join(p, same_host(F.col("host"), F.col("p_host")))
        .where(F.col("held") > F.lit(share) * F.col("docs"))
        .select(F.col("host").alias("c_host"), F.col("h").alias("c_h"))
    )
    lost = (
        rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.words")
        .join(common, same_host(F.col("host"), F.col("c_host")) & (F.col("h") == F.col("c_h")))
        .groupBy("row").agg(F.sum("words").alias("n_common_words"))
    )
    n, common_words = F.col("n_words"), F.coalesce("n_common_words", F.lit(0))
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    return rows.join(lost, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), common_words.alias("n_common_words"),
        (~failed & (n - common_words >= F.lit(left) * n)).alias("kept"),
    )


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (
  SELECT rid, host, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT rid, host, unnest(string_split(t, chr(10))) AS l FROM docs)
  WHERE len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) > 0),
per_doc AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY rid),
normal AS (SELECT rid, host, lower(array_to_string(lw, ' ')) AS h, len(lw) AS words FROM lines),
held AS (SELECT host, h, count(DISTINCT rid) AS held FROM normal GROUP BY host, h),
hosts AS (SELECT host, count(*) AS docs FROM docs GROUP BY host),
common AS (SELECT host, h FROM held JOIN hosts USING (host) WHERE held > 20 AND held > 0.001 * docs),
lost AS (SELECT rid, sum(words) AS n_common_words FROM normal JOIN common USING (host, h) GROUP BY rid),
win AS (
  SELECT rid, i, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) >= 2),
covered AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_common_words, 0)::BIGINT AS n_common_words
  FROM docs LEFT JOIN per_doc USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN lost USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_common_words,
       NOT base_failed AND n_words - n_common_words >= 0.3 * n_words AS kept
FROM f
"""
