"""URL filter by rules and, where none fits, a character language-model ratio.

URLs that an allow or block rule decides train two character models, one of
accepted and one of rejected URLs: variable order up to two characters of
context, smoothed by Witten-Bell interpolation with the shorter contexts. A
URL's score is log P(accepted) - log P(rejected) per character, in whole
millionths; the threshold is calibrated midway between the mean scores of the
accepted and of the rejected URLs. All counts cover all URLs.

Everything is a DataFrame expression. Characters are folded to an alphabet of
SYMBOLS, so the table of the ratio of every possible trigram has at most
len(SYMBOLS) ** 3 rows (under 100,000): that is the proven bound of what is
broadcast. Trigrams are counted with partial sums, so none is hot; scores are
added per row.

NULL URLs and those without "://" have an empty host and path, which still
get a verdict from the models. If a class has no URL, its model is uniform and
the threshold 0. Rows may repeat. An empty table gives an empty result.
URLs of any length are read from `://` to `?` or `#`. Only the id and the URL are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import store

RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789./:_%~-"
#: Letters, one sign for all others, the start (twice before a URL) and the end.
SYMBOLS = LETTERS + "*^$"
MICRO = 1_000_000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[str, ...]) -> Column:
    """struct<verdict, rule> of the longest rule that fits, or NULL."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for text in sorted(rules, key=lambda r: len(r.split(" ", 1)[1])):
        verdict, rule = text.split(" ", 1)
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def folded(host: Column, path: Column) -> Column:
    """^^, the host and path in lower case and the alphabet, $."""
    signs = F.regexp_replace(F.lower(F.concat(host, path)), "(?s)[^a-z0-9./:_%~-]", "*")
    return F.concat(F.lit("^^"), signs, F.lit("$"))


def trigrams(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))


def ratios(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """gram, micro: the log ratio of each possible trigram, in millionths. counts: gram, accepted, rejected."""
    grid = spark.range(1)
    for name in ("a", "b", "c"):
        grid = grid.select("*", F.explode(F.array(*map(F.lit, SYMBOLS))).alias(name))
    g3 = counts.select(F.substring("gram", 1, 1).alias("a"), F.substring("gram", 2, 1).alias("b"), F.substring("gram", 3, 1).alias("c"), "accepted", "rejected")

    def level(keys: list[str], order: int) -> tuple[DataFrame, DataFrame]:
        """Counts of (context, character) and sums and kinds by context."""
        pairs = g3.groupBy(*keys).agg(*(F.sum(k).alias(f"{k}_{order}") for k in ("accepted", "rejected")))
        sums = pairs.groupBy(*keys[:-1]).agg(
            *(F.sum(f"{k}_{order}").alias(f"{k}_sum{order}") for k in ("accepted", "rejected")),
            *(F.count_if(F.col(f"{k}_{order}") > 0).alias(f"{k}_kinds{order}") for k in ("accepted", "rejected")),
        )
        return pairs, sums

    table = grid
    for keys, order in ((["c"], 1), (["b", "c"], 2), (["a", "b", "c"], 3)):
        pairs, sums = level(keys, order)
        table = table.join(F.broadcast(pairs), keys, "left")
        # At most len(SYMBOLS) ** 2 contexts; the shortest has one row.
        table = table.join(F.broadcast(sums), keys[:-1], "left") if keys[:-1] else table.join(F.broadcast(sums.withColumn("c", F.explode(F.array(*map(F.lit, SYMBOLS))))), "c", "left")
    logs = {}
    for kind in ("accepted", "rejected"):
        p = F.lit(1.0 / len(SYMBOLS))
        for order in (1, 2, 3):
            n, total, kinds = (F.coalesce(F.col(f"{kind}_{x}"), F.lit(0)).cast("double") for x in (order, f"sum{order}", f"kinds{order}"))
            p = F.when(total > 0, (n + kinds * p) / (total + kinds)).otherwise(p)
        logs[kind] = F.log(p)
    return table.select(F.concat("a", "b", "c").alias("gram"), F.round((logs["accepted"] - logs["rejected"]) * MICRO).cast("long").alias("micro"))


def judge(df: DataFrame, rules: tuple[str, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (millionths per character) of every row."""
    spark = df.sparkSession
    url = F.col(url_col).cast("string")
    parsed = df.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = store(
        parsed.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("fit"),
                      folded(F.col("host"), F.col("path")).alias("signs"), F.monotonically_increasing_id().alias("row")),
        "urls",
    )
    counts = (
        rows.where("fit IS NOT NULL").select("fit.verdict", F.explode(trigrams(F.col("signs"))).alias("gram"))
        .groupBy("gram").agg(F.count_if(F.col("verdict") == "allow").alias("accepted"), F.count_if(F.col("verdict") == "block").alias("rejected"))
    )
    model = ratios(spark, store(counts, "url-trigrams"))
    sums = (
        rows.select("row", F.explode(trigrams(F.col("signs"))).alias("gram")).join(F.broadcast(model), "gram")
        .groupBy("row").agg(F.sum("micro").alias("micro"), F.count(F.lit(1)).alias("n"))
    )
    scored = store(rows.join(sums, "row").select("page_id", "host", "path", "fit", (F.col("micro") / F.col("n")).alias("score")), "url-scores")
    means = scored.where("fit IS NOT NULL").agg(*(F.avg(F.when(F.col("fit.verdict") == k, F.col("score"))).alias(k) for k in ("allow", "block")))
    limit = means.select(F.coalesce(F.round((F.col("allow") + F.col("block")) / 2).cast("long"), F.lit(0)).alias("threshold")).first()["threshold"]
    return scored.select(
        "page_id", "host", "path", "fit.rule",
        F.coalesce("fit.verdict", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"),
        F.floor("score").alias("score"),
    )


def _oracle() -> str:
    longest = sorted((r.split(" ", 1) for r in RULES), key=lambda r: -len(r[1]))

    def fits(rule: str) -> str:
        domain, slash, rest = rule.partition("/")
        return f"((host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash + rest}'))"

    case = lambda i: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[i]}'" for r in longest) + " END"
    v = len(SYMBOLS)

    def prob(kind: str) -> str:
        p = f"(1.0::DOUBLE / {v})"
        for o in (1, 2, 3):
            n, total, kinds = (f"coalesce({kind}_{x}, 0)::DOUBLE" for x in (o, f"sum{o}", f"kinds{o}"))
            p = f"(CASE WHEN {total} > 0 THEN ({n} + {kinds} * {p}) / ({total} + {kinds}) ELSE {p} END)"
        return p

    levels = ""
    for o, keys in ((1, "c"), (2, "b, c"), (3, "a, b, c")):
        context = ", ".join(keys.split(", ")[:-1]) or "1"
        levels += f"""
l{o} AS (SELECT {keys}, count(*) FILTER (verdict = 'allow') AS accepted_{o}, count(*) FILTER (verdict = 'block') AS rejected_{o} FROM train GROUP BY {keys}),
s{o} AS (SELECT {context} AS k1{', ' + context if o > 1 else ''}, sum(accepted_{o}) AS accepted_sum{o}, sum(rejected_{o}) AS rejected_sum{o},
  count(*) FILTER (accepted_{o} > 0) AS accepted_kinds{o}, count(*) FILTER (rejected_{o} > 0) AS rejected_kinds{o} FROM l{o} GROUP BY {context}),"""
    levels = levels.replace("a, b AS k1, a, b", "a, b").replace("b AS k1, b", "b")
    return rf"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (SELECT *, {case(0)} AS verdict, {case(1)} AS rule,
  '^^' || regexp_replace(lower(host || path), '(?s)[^a-z0-9./:_%~-]', '*', 'g') || '$' AS signs FROM u),
g AS (SELECT rid, verdict, signs[i:i+2] AS gram FROM (SELECT rid, verdict, signs, unnest(range(1, length(signs) - 1)) AS i FROM r)),
train AS (SELECT verdict, gram[1:1] AS a, gram[2:2] AS b, gram[3:3] AS c FROM g WHERE verdict IS NOT NULL),{levels}
seen AS (SELECT DISTINCT gram, gram[1:1] AS a, gram[2:2] AS b, gram[3:3] AS c FROM g),
model AS (SELECT gram, round((ln({prob('accepted')}) - ln({prob('rejected')})) * {MICRO})::BIGINT AS micro
  FROM seen LEFT JOIN l1 USING (c) LEFT JOIN s1 ON true LEFT JOIN l2 USING (b, c) LEFT JOIN s2 USING (b) LEFT JOIN l3 USING (a, b, c) LEFT JOIN s3 USING (a, b)),
scores AS (SELECT rid, sum(micro)::DOUBLE / count(*) AS score FROM g JOIN model USING (gram) GROUP BY rid),
x AS (SELECT * FROM r JOIN scores USING (rid)),
t AS (SELECT coalesce(round((avg(score) FILTER (verdict = 'allow') + avg(score) FILTER (verdict = 'block')) / 2)::BIGINT, 0) AS threshold FROM x)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict,
       floor(score)::BIGINT AS score FROM x, t
"""


ORACLE = _oracle()
