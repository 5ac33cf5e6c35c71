"""URL filters: host and path rules, and a character language-model ratio for the rest.

Two variable-order Markov models over characters are counted, of URLs that the rules allow
and of URLs that they block. A character's probability given up to ORDER - 1 earlier ones is
smoothed by Witten-Bell: each context mixes what it has seen with the next shorter one, and a
context seen under SEEN times is passed over for the shorter one. A URL's score is the mean
over its characters of log(allowed / blocked). The cut is calibrated on URLs that neither model
has counted, HELD sixteenths of them by the digest of the URL: of all hundredths, the one that
best separates allowed from blocked URLs there (largest difference of their shares at or above
it; of equal ones the lowest).

Everything is built-in functions. Distinct URLs are counted and scored once, so a URL with a
third of all rows is one row; they are dealt to all of the session's partitions before their
n-grams are made. Characters are folded to an alphabet of fixed size, so the table of
n-grams is bounded; it is broadcast up to BROADCAST_GRAMS rows and shuffled beyond.

A null URL has empty host and path, no rule, and is allowed. Without both allowed and blocked
URLs to calibrate on, the rest is allowed.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypath.llm.shared import materialize

#: (verdict, host, path); a rule fits its host and all subdomains. They become one expression.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MOST_RULES = 500

ORDER = 4
SEEN = 3
#: Letters, 0 for any digit, punctuation, ~ for the rest, ^ before the start, $ for the end.
KEPT = "a-z0/.:?=&#%+_\\-"
ALPHABET = 26 + 1 + 11 + 3
BROADCAST_GRAMS = 300_000
HELD = "012"  # first digits of the MD5 of a URL that is kept for the calibration
HUNDREDTHS = 1000  # scores beyond 10 count as 10 in the calibration


def split(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    form = "://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, form, 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(url, form, 2)


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} can be one expression")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(url: Column) -> Column:
    """The n-gram that ends at each character of the folded URL, and at its end."""
    folded = F.translate(url, string.ascii_uppercase + "123456789", string.ascii_lowercase + "0" * 9)
    folded = F.concat(F.lit("^" * (ORDER - 1)), F.regexp_replace(folded, f"[^{KEPT}]", "~"), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(folded) - (ORDER - 1)), lambda i: F.substring(folded, i, F.lit(ORDER)))


def _log_ratio(counts: DataFrame) -> DataFrame:
    """(gram, micro): a million times log(allowed / blocked) of the last character, from (gram, allow, block)."""
    kinds = ("allow", "block")
    p = {k: F.lit(1.0 / ALPHABET) for k in kinds}
    rows = counts
    for n in range(1, ORDER + 1):  # n-grams of rising length
        suffix, context = F.substring("gram", ORDER - n + 1, n), F.substring("gram", ORDER - n + 1, n - 1)
        here = counts.groupBy(suffix.alias("s")).agg(*(F.sum(k).alias(f"n{n}_{k}") for k in kinds))
        ctx = here.groupBy(F.substring("s", 1, n - 1).alias("c")).agg(*(F.sum(f"n{n}_{k}").alias(f"c{n}_{k}") for k in kinds), *(F.count_if(F.col(f"n{n}_{k}") > 0).alias(f"t{n}_{k}") for k in kinds))
        rows = rows.withColumns({"s": suffix, "c": context}).join(here, "s").join(ctx, "c").drop("s", "c")
        for k in kinds:
            seen, count, kinds_seen = F.col(f"c{n}_{k}"), F.col(f"n{n}_{k}"), F.col(f"t{n}_{k}")
            rows = rows.withColumn(f"p{n}_{k}", F.when(seen >= SEEN, (count + kinds_seen * p[k]) / (seen + kinds_seen)).otherwise(p[k]))
            p[k] = F.col(f"p{n}_{k}")
    return rows.select("gram", F.round((F.log(p["allow"]) - F.log(p["block"])) * 1e6).cast("long").alias("micro"))


def _held(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 1).isin(*HELD)


def _distinct(pages: DataFrame) -> DataFrame:
    """(url, a, b): each URL once, and in how many pages it is allowed and blocked by a rule; 0 for those held out."""
    count = lambda verdict: F.count_if((F.col("found.verdict") == verdict) & ~_held(F.col("url")))
    return pages.where("url is not null").groupBy("url").agg(count("allow").alias("a"), count("block").alias("b"))


def _dealt(urls: DataFrame, *cols: str) -> DataFrame:
    """A row for each n-gram of each URL: URLs are spread first, as each gives some sixty rows."""
    wide = urls.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "url")
    return wide.select(*cols, F.explode(_grams(F.col("url"))).alias("gram"))


def scores(pages: DataFrame) -> DataFrame:
    """(url, hundredths): floor of 100 times the mean log ratio, of each distinct URL of (url, found)."""
    urls = materialize(_distinct(pages), "urls")
    counts = _dealt(urls, "a", "b").groupBy("gram").agg(F.sum("a").alias("allow"), F.sum("b").alias("block"))
    ratio = materialize(_log_ratio(materialize(counts, "grams")), "ratio")
    small = ratio.count() <= BROADCAST_GRAMS
    rows = _dealt(urls, "url").join(F.broadcast(ratio) if small else ratio, "gram")
    mean = F.sum("micro") / F.count("*") / 1e6
    return rows.groupBy("url").agg(F.floor(mean * 100).alias("hundredths"))


def calibrated(labelled: DataFrame) -> int | None:
    """The hundredth from which URLs are allowed, from (hundredths, verdict); None without both verdicts."""
    clipped = F.greatest(F.least("hundredths", F.lit(HUNDREDTHS)), F.lit(-HUNDREDTHS))
    bins = labelled.groupBy(clipped.alias("at")).agg(F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block")).collect()
    bins.sort(key=lambda r: -r["at"])  # at most 2 * HUNDREDTHS + 1 rows
    all_a, all_b = sum(r["allow"] for r in bins), sum(r["block"] for r in bins)
    if not all_a or not all_b:
        return None
    best, a, b = None, 0, 0
    for r in bins:
        a, b = a + r["allow"], b + r["block"]
        gap = a * all_b - b * all_a
        if best is None or gap >= best[0]:
            best = gap, r["at"]
    return best[1]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages`` (page_id, url)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = split(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("found", matched(F.col("host"), F.col("path"), rules))
    scored = materialize(scores(rows), "scores")
    cut = calibrated(rows.where(F.col("found").isNotNull() & _held(F.col("url"))).join(scored, "url").select("hundredths", "found.verdict"))
    by_score = F.when(F.col("hundredths") < cut, "block").otherwise("allow") if cut is not None else F.lit("allow")
    ruled = rows.where("found is not null").select("page_id", "host", "path", "found.rule", "found.verdict")
    rest = rows.where("found is null").join(scored, "url", "left").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), by_score.alias("verdict"))
    return ruled.unionByName(rest)


def _sql() -> str:
    fits = " ".join(
        f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    steps, last = "", {"a": f"{1 / ALPHABET!r}::DOUBLE", "b": f"{1 / ALPHABET!r}::DOUBLE"}
    joins, cols = "", ""
    for n in range(1, ORDER + 1):
        steps += f""", s{n} AS (SELECT right(gram, {n}) AS s, sum(a) AS a, sum(b) AS b FROM k GROUP BY 1)
, c{n} AS (SELECT left(s, {n - 1}) AS c, sum(a) AS a, sum(b) AS b, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb FROM s{n} GROUP BY 1)"""
        joins += f" JOIN s{n} ON s{n}.s = right(k.gram, {n}) JOIN c{n} ON c{n}.c = left(right(k.gram, {n}), {n - 1})"
        for x in "ab":
            last[x] = f"(CASE WHEN c{n}.{x} >= {SEEN} THEN (s{n}.{x} + c{n}.t{x} * {last[x]}) / (c{n}.{x} + c{n}.t{x})::DOUBLE ELSE {last[x]} END)"
    held = "left(md5(url), 1) IN (" + ", ".join(f"'{x}'" for x in HELD) + ")"
    upper, lower = string.ascii_uppercase + "123456789", string.ascii_lowercase + "0" * 9
    return f"""
WITH p AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r AS (
  SELECT *, CASE {fits} END AS found FROM p
), f AS (
  SELECT url, count(*) FILTER (found LIKE 'allow%' AND NOT {held}) AS a, count(*) FILTER (found LIKE 'block%' AND NOT {held}) AS b,
         '{"^" * (ORDER - 1)}' || regexp_replace(translate(url, '{upper}', '{lower}'), '[^{KEPT}]', '~', 'g') || '$' AS t
  FROM r WHERE url IS NOT NULL GROUP BY url
), g AS (
  SELECT url, a, b, unnest(list_transform(range(1, length(t) - {ORDER - 2}), lambda i: substr(t, i, {ORDER}))) AS gram FROM f
), k AS (
  SELECT gram, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM g GROUP BY gram
){steps}
, m AS (
  SELECT k.gram, round((ln({last["a"]}) - ln({last["b"]})) * 1e6)::BIGINT AS micro FROM k{joins}
), z AS (
  SELECT url, floor(sum(micro)::DOUBLE / count(*) / 1e6 * 100)::BIGINT AS h FROM g JOIN m USING (gram) GROUP BY url
), e AS (
  SELECT greatest(least(h, {HUNDREDTHS}), -{HUNDREDTHS}) AS pos, count(*) FILTER (found LIKE 'allow%') AS a, count(*) FILTER (found LIKE 'block%') AS b
  FROM r JOIN z USING (url) WHERE found IS NOT NULL AND {held} GROUP BY 1
), w AS (
  SELECT pos, sum(a) OVER (ORDER BY pos DESC) AS ca, sum(b) OVER (ORDER BY pos DESC) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM e
), cut AS (
  SELECT pos FROM w WHERE na > 0 AND nb > 0 ORDER BY ca * nb - cb * na DESC, pos LIMIT 1
)
SELECT page_id, host, path, substr(found, 7) AS rule,
       CASE WHEN found IS NOT NULL THEN left(found, 5) WHEN h < (SELECT pos FROM cut) THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN z USING (url)
"""


SQL = _sql()
