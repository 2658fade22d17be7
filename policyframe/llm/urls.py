"""URL filters as a temporal list join, in DataFrame functions only.

A list is a table of dated events: at `effective_at` a pattern enters the list (action 'add') or leaves it ('remove'), for
a category. Events become validity intervals [from, to), `to` being the next event of the pattern and category. A capture
is blocked if, when it was fetched, an entry was active for its host, a parent domain of it, or a leading part of its path
under that host ("example.org/en" covers "example.org/en/1"; "www." belongs to the host like any label). Of several, the longest
pattern is reported, then the first category.

Each distinct capture is turned into its possible patterns, no longer than the list's longest, and patterns that never were on the list are dropped; the rest meet
the intervals in an as-of join: an equi-join on the pattern with the fetch time in the interval. A pattern that more than one
capture in 1,024 has, such as a top-level domain or the host of a third of all captures, meets the list by broadcast; there are
fewer than 1,024 times as many of them as patterns a capture. The others meet it by shuffle. The captures' other columns never
take part.

Edge cases: captures with null or unparsable URLs or null fetch times are not blocked; events with a null pattern, time or
unknown action count for nothing; of events of a pattern and category at one instant, 'remove' wins; a null category is a
category, and comes first; repeated captures each get their row; empty tables give empty results or none blocked; extra columns
of captures, of any name, pass through; URLs of any length cost time in proportion to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyframe.llm.shared import HOT, cut, table

#: pages has no fetch times: page n counts as fetched n % 730 days after this day.
FIRST_DAY, DAYS = "2023-10-01", 730
#: No table has a list either: the one that op7 applies is drawn from the pages' own hosts, and the first parts of their paths, by
#: the first digits of their MD5. One in LISTED is added on a day by digits 3 to 5; half of those go some days later, by digits 6
#: and 7, and half of these come back after as many days again.
LISTED, CATEGORIES = 3, ("adult", "gambling", "malware", "spam")


def drawn_list(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(pattern, category, action, effective_at), as told above."""
    url = F.col(url_col)
    first = F.lower(F.regexp_extract(url, r"^[^/?#]*//[^/?#]*/([^/?#]+)/", 1))
    places = pages.select(F.explode(F.array(host(url), F.concat(host(url), F.lit("/"), first))).alias("pattern")).filter("pattern != '' and not endswith(pattern, '/')").distinct()
    digits = lambda a, n: F.conv(F.substring(F.md5("pattern"), a, n), 16, 10).cast("int")
    places = places.select("pattern", digits(1, 2).alias("d"), (digits(3, 3) % DAYS).alias("day"), (digits(6, 2) % 180 + 20).alias("days")).filter(F.col("d") % LISTED == 0)
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("days") % len(CATEGORIES) + 1)
    steps = F.array(F.struct(F.lit("add").alias("action"), F.col("day").alias("day")))
    steps = F.when(F.col("d") % 2 == 0, F.concat(steps, F.array(F.struct(F.lit("remove").alias("action"), (F.col("day") + F.col("days")).alias("day"))))).otherwise(steps)
    steps = F.when(F.col("d") % 4 == 0, F.concat(steps, F.array(F.struct(F.lit("add").alias("action"), (F.col("day") + 2 * F.col("days")).alias("day"))))).otherwise(steps)
    out = places.select("pattern", category.alias("category"), F.explode(steps).alias("s"))
    return out.select("pattern", "category", "s.action", F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("s.day")).cast("timestamp").alias("effective_at"))


def intervals(events: DataFrame) -> DataFrame:
    """(pattern, category, from, to) of the times in which each pattern is on the list."""
    own = events.filter("pattern is not null and effective_at is not null and action in ('add', 'remove')")
    own = own.withColumn("pattern", F.lower(F.rtrim(F.col("pattern"), F.lit("/")))).groupBy("pattern", "category", "effective_at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("pattern", "category").orderBy("effective_at")
    out = own.withColumn("to", F.lead("effective_at").over(order)).filter("action = 'add'")
    return out.select("pattern", "category", F.col("effective_at").alias("from"), "to")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::\d*)?(?:[/?#].*)?$", 1))


def patterns(url: Column, labels: int, parts: int) -> Column:
    """Every pattern that would cover the URL: host and parent domains of at most so many labels, and host with each leading part
    of the path, of at most so many steps. Without these bounds a URL of n steps would give texts of n * n steps together."""
    path = F.slice(F.filter(F.split(F.regexp_extract(url, r"^[^/?#]*//[^/?#]*/([^?#]*)", 1), "/"), lambda s: s != ""), 1, parts)
    names = F.split(host(url), r"\.")
    names = F.slice(names, F.greatest(F.lit(1), F.size(names) - labels + 1), F.lit(labels))
    domains = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    steps = F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.concat(host(url), F.lit("/"), F.lower(F.array_join(F.slice(path, F.lit(1), i), "/")))))
    return F.when(host(url) != "", F.concat(domains, F.coalesce(steps, F.array().cast("array<string>"))))


def filter_urls(captures: DataFrame, events: DataFrame, *, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Every row of captures with its columns, and blocked, entry, category (in place of columns of these names). events:
    (pattern, category, action, effective_at)."""
    # Own columns go by number: no name of theirs can meet one of ours.
    own = captures.select(F.col(f"`{url_col}`").alias("u"), F.col(f"`{time_col}`").alias("at"), *[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(captures.columns)])
    keys = own.select("u", "at").filter("u is not null and at is not null").groupBy("u", "at").agg(F.count("*").alias("rows"))
    active = cut(intervals(events), "intervals")
    # Longer patterns than the list's longest cannot be on it.
    place = F.split("pattern", "/")
    labels, parts = active.agg(F.max(F.size(F.split(place[0], r"\."))), F.max(F.size(place) - 1)).first()
    spread = keys.select("u", "at", F.explode(patterns(F.col("u"), labels or 1, parts or 0)).alias("pattern"))
    # Patterns that never were on the list go; of the others, those of many captures are told.
    listed = spread.groupBy("pattern").agg(F.count("*").alias("times")).join(active.select("pattern").distinct(), "pattern", "left_semi")
    listed = cut(listed, "listed")
    hot = listed.filter(F.col("times") > keys.count() / HOT).select("pattern")  # under HOT a level of a URL
    when = (F.col("at") >= F.col("from")) & (F.col("to").isNull() | (F.col("at") < F.col("to")))
    near = spread.join(F.broadcast(hot), "pattern", "left_semi").join(F.broadcast(active.join(F.broadcast(hot), "pattern", "left_semi")), "pattern")
    far = spread.join(F.broadcast(hot), "pattern", "left_anti").join(active.join(F.broadcast(hot), "pattern", "left_anti"), "pattern")
    found = near.unionByName(far).filter(when)
    found = found.groupBy("u", "at").agg(F.min(F.struct((-F.char_length("pattern")).alias("n"), "pattern", "category")).alias("best"))
    rows = own.join(found, ["u", "at"], "left")
    added = {"blocked": F.col("best").isNotNull(), "entry": F.col("best.pattern"), "category": F.col("best.category")}
    return rows.select(*[F.col(f"own{i}").alias(c) for i, c in enumerate(captures.columns) if c not in added], *[v.alias(k) for k, v in added.items()])


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    at = F.expr(f"timestamp_seconds(unix_seconds(timestamp'{FIRST_DAY} 00:00:00') + pmod(page_id, {DAYS}) * 86400)")
    captures = pages.select("page_id", "url", at.alias("fetched_at"))
    return filter_urls(captures, drawn_list(pages)).select("page_id", "url", "blocked", "entry", "category")


OP7_SQL = f"""WITH parts AS (
  SELECT page_id, url, DATE '{FIRST_DAY}' + CAST(page_id % {DAYS} AS INTEGER) AS day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
         lower(regexp_extract(url, '^[^/?#]*//[^/?#]*(/[^?#]*)', 1)) AS path,
         lower(regexp_extract(url, '^[^/?#]*//[^/?#]*/([^/?#]+)/', 1)) AS first FROM pages
), drawn AS (
  SELECT pattern, ('0x' || md5(pattern)[1:2])::INTEGER AS d, ('0x' || md5(pattern)[3:5])::INTEGER % {DAYS} AS start, ('0x' || md5(pattern)[6:7])::INTEGER % 180 + 20 AS days
  FROM (SELECT DISTINCT unnest([host, CASE WHEN first <> '' THEN host || '/' || first END]) AS pattern FROM parts) WHERE pattern <> ''
), listed AS (SELECT *, {list(CATEGORIES)}[days % {len(CATEGORIES)} + 1] AS category FROM drawn WHERE d % {LISTED} = 0),
events AS (
  SELECT pattern, category, 'add' AS action, DATE '{FIRST_DAY}' + start AS day FROM listed
  UNION ALL SELECT pattern, category, 'remove', DATE '{FIRST_DAY}' + start + days FROM listed WHERE d % 2 = 0
  UNION ALL SELECT pattern, category, 'add', DATE '{FIRST_DAY}' + start + 2 * days FROM listed WHERE d % 4 = 0
), active AS (
  SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY pattern, category ORDER BY day) AS until FROM events) WHERE action = 'add'
), found AS (
  SELECT page_id, pattern, category, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern, category) AS n
  FROM parts JOIN active ON parts.day >= active.day AND (until IS NULL OR parts.day < until)
   AND (host = pattern OR ends_with(host, '.' || pattern) OR starts_with(host || path || '/', pattern || '/') AND contains(pattern, '/'))
)
SELECT page_id, url, pattern IS NOT NULL AS blocked, pattern AS entry, category FROM parts LEFT JOIN (SELECT * FROM found WHERE n = 1) USING (page_id)
"""
