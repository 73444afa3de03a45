"""URL filters: dated list entries as validity intervals, joined as of the fetch day of every capture.

Defined results: a null or unreadable URL has a null host, matches nothing and is ``unlisted``; list rows with a
null key, list, action or day are ignored; a repeated row counts once; a key removed and added on one day is removed;
empty tables give empty results; all other columns of either table are ignored. A URL that several active entries
match is decided by the most specific key (most labels, a path before none), then by the list name in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardflow.llm.common import table
from wardflow.llm.registry import query


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def first_segment(url: Column) -> Column:
    """First path segment as written; null where the path is empty."""
    part = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([^/?#\s]+)", 1)
    return F.when(part != "", part)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, key, action add/remove, day) rows as (list, key, valid_from, valid_to) with an exclusive end, null if open.

    Rows are reduced to one per list, key and day first, so a key's window is bounded by the calendar. Additions of
    an active key extend its interval.
    """
    per_day = (
        entries.where("list is not null and key is not null and day is not null and action in ('add', 'remove')")
        .groupBy("list", F.lower("key").alias("key"), "day").agg(F.max("action").alias("action"))
    )
    by_key = Window.partitionBy("list", "key").orderBy("day")
    turns = per_day.withColumn("before", F.lag("action").over(by_key)).where("before is null or before <> action")
    return (
        turns.withColumn("valid_to", F.lead("day").over(by_key)).where("action = 'add'")
        .select("list", "key", F.col("day").alias("valid_from"), "valid_to")
    )


def candidate_keys(host: Column, segment: Column) -> Column:
    """Every key that can match: the host and its parent domains, each with and without the first path segment."""
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    with_path = F.when(segment.isNotNull(), F.transform(domains, lambda d: F.concat(d, F.lit("/"), F.lower(segment)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(domains, with_path))


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """Every capture with the entry that decides it on its day.

    Captures are first reduced to distinct (host, segment, day); only those meet the intervals, so a host with a
    third of all captures costs as many rows as it has days. The decisions join back on the whole triple.
    """
    seen = captures.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("fetched")).withColumns(
        {"host": host_of(F.col("url")), "segment": first_segment(F.col("url"))}
    )
    asked = seen.where("host is not null and fetched is not null").select("host", "segment", "fetched").distinct()
    keys = asked.withColumn("key", F.explode(candidate_keys(F.col("host"), F.col("segment"))))
    spans = validity_intervals(entries)
    hits = keys.join(spans, "key").where("valid_from <= fetched and (valid_to is null or fetched < valid_to)")
    rank = F.struct(-F.size(F.split("key", r"\.")), -F.length("key"), F.col("list"))
    best = hits.groupBy("host", "segment", "fetched").agg(
        F.min_by(F.struct("list", "key", "valid_from", "valid_to"), rank).alias("hit"), F.count("*").alias("n_active")
    ).withColumnsRenamed({"host": "h", "segment": "s", "fetched": "f"})
    on = (F.col("host") == F.col("h")) & F.col("segment").eqNullSafe(F.col("s")) & (F.col("fetched") == F.col("f"))
    return seen.join(best, on, "left").select(
        id_col, "url", "host", "fetched", F.coalesce("hit.list", F.lit("unlisted")).alias("decision"), F.col("hit.key").alias("matched_key"),
        F.col("hit.valid_from").alias("valid_from"), F.col("hit.valid_to").alias("valid_to"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
    )


def _number(x: str, at: int) -> str:
    """SQL text of a number below 4096 drawn from a key, alike in Spark and in the checking SQL."""
    return f"conv(substring(md5({x}), {at}, 3), 16, 10)"


def page_lists(pages: DataFrame) -> DataFrame:
    """Dated entries over the hosts of the pages table: half of the hosts, their parents and some first segments."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), first_segment(F.col("url")).alias("segment")).where("host is not null")
    keys = (
        hosts.select(F.col("host").alias("key"))
        .unionByName(hosts.select(F.regexp_replace("host", r"^[^.]+\.", "").alias("key")))
        .unionByName(hosts.where("segment is not null").select(F.expr("concat(host, '/', lower(segment))").alias("key"))).distinct()
    )
    drawn = keys.selectExpr("key", *[f"cast({_number('key', 1 + 3 * i)} as int) as r{i}" for i in range(5)]).where("r0 % 2 = 0")
    return drawn.selectExpr(
        "case when r1 % 4 = 0 then 'allow' else 'block' end as list", "key",
        "explode(array(named_struct('action', 'add', 'day', date_add(date'2024-01-01', r2 % 300)), named_struct('action', 'remove', 'day', date_add(date'2024-01-01', r2 % 300 + r3 % 200)),"
        " named_struct('action', 'add', 'day', date_add(date'2024-01-01', r2 % 300 + r3 % 200 + r4 % 150)))) as e",
    ).where("e.action = 'add' or cast(conv(substring(md5(key), 16, 3), 16, 10) as int) % 3 <> 0").select("list", "key", "e.action", "e.day")


SQL = r"""
with seen as (
  select page_id, url, date '2024-01-01' + cast(page_id * 37 % 730 as int) as fetched,
    nullif(rtrim(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') as host,
    nullif(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([^/?#\s]+)', 1), '') as segment
  from pages),
keys as (
  select host as key from seen where host is not null
  union select regexp_replace(host, '^[^.]+\.', '') from seen where host is not null
  union select host || '/' || lower(segment) from seen where host is not null and segment is not null),
drawn as (
  select key, ('0x' || substring(md5(key), 1, 3))::int as r0, ('0x' || substring(md5(key), 4, 3))::int as r1, ('0x' || substring(md5(key), 7, 3))::int as r2,
    ('0x' || substring(md5(key), 10, 3))::int as r3, ('0x' || substring(md5(key), 13, 3))::int as r4, ('0x' || substring(md5(key), 16, 3))::int as r5 from keys),
listed as (select *, case when r1 % 4 = 0 then 'allow' else 'block' end as list, date '2024-01-01' + r2 % 300 as d1,
    date '2024-01-01' + (r2 % 300 + r3 % 200) as d2, date '2024-01-01' + (r2 % 300 + r3 % 200 + r4 % 150) as d3 from drawn where r0 % 2 = 0),
entries as (
  select list, key, 'add' as action, d1 as day from listed union all select list, key, 'remove', d2 from listed where r5 % 3 <> 0
  union all select list, key, 'add', d3 from listed),
per_day as (select list, key, day, max(action) as action from entries group by 1, 2, 3),
turns as (select * from (select *, lag(action) over (partition by list, key order by day) as before from per_day) where before is null or before <> action),
spans as (select * from (select list, key, action, day as valid_from, lead(day) over (partition by list, key order by day) as valid_to from turns) where action = 'add'),
domains as (
  select page_id, segment, fetched, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') as d
  from (select *, unnest(range(1, len(string_split(host, '.')) + 1)) as i from seen where host is not null)),
asked as (select page_id, fetched, d as key from domains union select page_id, fetched, d || '/' || lower(segment) from domains where segment is not null),
hits as (
  select page_id, list, a.key, valid_from, valid_to, count(*) over (partition by page_id) as n_active,
    row_number() over (partition by page_id order by len(string_split(a.key, '.')) desc, length(a.key) desc, list) as k
  from asked a join spans s on a.key = s.key and valid_from <= fetched and (valid_to is null or fetched < valid_to))
select s.page_id, s.url, s.host, s.fetched, coalesce(h.list, 'unlisted') as decision, h.key as matched_key, h.valid_from, h.valid_to,
  cast(coalesce(n_active, 0) as bigint) as n_active
from seen s left join hits h on s.page_id = h.page_id and h.k = 1
"""


@query("op10_url_list_join", SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    captures = pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id * 37 % 730 as int))").alias("fetched"))
    return filter_captures(captures, page_lists(pages))
