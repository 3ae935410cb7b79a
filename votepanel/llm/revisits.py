"""Resolution of not-modified revisits in web archives.

A revisit record (status 304) has headers but no body; it stands for the latest earlier full response of the same canonical URL, if its
validators agree. The resolved record takes the stored response's body and headers, with the permitted headers of the revisit
(those a 304 may update) in place of the stored ones.

The as-of join is done by order, not by pairs. Records are range-partitioned by (URL, time), so a URL with any share of the
records spreads over as many partitions as it fills; the partition number is stored with the rows. Inside a partition a
window finds the last full response of the URL before each record. What comes from earlier partitions is carried over a summary
with one row per URL and partition. Bodies are not moved: records carry the digest and the size of theirs.

Defined results: records without URL, time or id take no part; a response at the same time as a revisit is not earlier than it; of
responses at one time the one with the larger id is the latest; a revisit without earlier response is ``unmatched``, one
without any validator ``unchecked`` (it is not merged), one whose validators differ ``changed``; repeated records are resolved each;
null headers are no headers; no revisits, no rows. Header names are taken in lower case; the different values of names that differ
only in case are one value, joined by commas in the order of the names as spelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votepanel.session import cut_lineage

#: Headers that a not-modified answer may update (fixed values of the HTTP standard).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, no trailing slash, query parameters in order."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(/[^?]*)?", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: p != "")), "&")
    full = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(scheme != "", full).otherwise(plain)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _lower_names(headers: Column) -> Column:
    """Headers by lower-case name; names that meet have their different values joined."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))

    def value(name: Column) -> Column:
        same = F.array_sort(F.filter(entries, lambda e: (F.lower(e["key"]) == name) & e["value"].isNotNull()))
        return F.when(F.size(same) > 0, F.array_join(F.array_distinct(F.transform(same, lambda e: e["value"])), ", "))

    return F.when(F.size(names) == F.size(entries), F.transform_keys(headers, lambda k, v: F.lower(k))).otherwise(F.map_from_arrays(names, F.transform(names, value)))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records``: ``record_id, url, ts, status, headers map<string,string>, digest, n_bytes`` (digest and size of the body).

    Returns per revisit ``record_id, url, outcome, response_id, digest, n_bytes, headers`` (merged, as sorted ``name: value`` lines)."""
    headers = _lower_names(F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")))
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url"), F.col("ts").alias("ts"), (F.col("status") == 304).alias("revisit"), headers.alias("headers"), F.col("digest"), F.col("n_bytes").cast("long").alias("n_bytes")
    ).where("record_id is not null and url is not null and ts is not null and (revisit or status = 200)")
    order = F.struct("ts", "record_id")
    full = F.when(~F.col("revisit"), F.struct("ts", "record_id", "headers", "digest", "n_bytes"))
    # revisits before responses of their time
    placed = rows.withColumn("late", (~F.col("revisit")).cast("int")).repartitionByRange("url", "ts", "late", "record_id")
    placed = cut_lineage(placed.withColumn("part", F.spark_partition_id()), "records")
    inside = Window.partitionBy("part", "url").orderBy("ts", "late", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.last(full, ignorenulls=True).over(inside)).where("revisit").select("part", "url", "ts", "record_id", "headers", "near")
    summary = placed.groupBy("part", "url").agg(F.max_by(full, F.when(~F.col("revisit"), order)).alias("last"))
    carried = summary.withColumn("carried", F.last("last", ignorenulls=True).over(Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "url", "carried")
    both = near.join(carried, ["part", "url"], "left").withColumn("r", F.coalesce("near", "carried"))
    own, stored = F.col("headers"), F.col("r.headers")
    tag, date = F.try_element_at(own, F.lit("etag")), F.try_element_at(own, F.lit("last-modified"))
    agrees = F.when(tag.isNotNull(), F.coalesce(_weak(tag) == _weak(F.try_element_at(stored, F.lit("etag"))), F.lit(False))).otherwise(F.coalesce(date == F.try_element_at(stored, F.lit("last-modified")), F.lit(False)))
    outcome = F.when(F.col("r").isNull(), "unmatched").when(tag.isNull() & date.isNull(), "unchecked").when(agrees, "resolved").otherwise("changed")
    permitted = F.array(*[F.lit(x) for x in PERMITTED])
    updates = F.map_filter(own, lambda k, v: F.array_contains(permitted, k))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(updates, k)), updates)
    lines = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")
    ok = F.col("outcome") == "resolved"
    return both.withColumn("outcome", outcome).select("record_id", "url", "outcome", F.col("r.record_id").alias("response_id"), F.when(ok, F.col("r.digest")).alias("digest"), F.when(ok, F.col("r.n_bytes")).alias("n_bytes"), F.when(ok, lines).alias("headers"))


def archive_records(pages: DataFrame) -> DataFrame:
    """Records of an archive, derived from ``pages``: a full response per page, and a later revisit of every page's URL under another
    spelling; some revisits bring a weak tag, another tag, only a date, or no validator, some pages are revisited before they are
    stored, and pages share URLs."""
    page, size = F.col("page_id"), F.octet_length(F.col("html"))
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html")), 1, 16), F.lit('"'))
    stored = F.to_date(F.timestamp_seconds(F.lit(1_700_000_000) + page % 977 * 86_400)).cast("string")
    base = pages.select("page_id", "url", F.md5("html").alias("digest"), size.alias("n_bytes"), tag.alias("tag"), stored.alias("stored"), (F.lit(1_710_000_000) + page % 5 * 600).alias("at"))
    response = F.map_from_arrays(F.array(*[F.lit(x) for x in ("Content-Type", "Content-Length", "ETag", "Last-Modified", "Date", "Cache-Control")]), F.array(F.lit("text/html"), F.col("n_bytes").cast("string"), F.col("tag"), F.col("stored"), F.col("at").cast("string"), F.lit("max-age=60")))
    full = base.select((page * 2).alias("record_id"), "url", F.col("at").alias("ts"), F.lit(200).alias("status"), response.alias("headers"), "digest", "n_bytes")
    later = F.col("at") + F.when(page % 13 == 0, -4000).otherwise(page % 7 * 300)
    shown = F.when(page % 5 == 0, F.lit(None)).when(page % 5 == 1, F.concat(F.lit("W/"), F.col("tag"))).when(page % 5 == 2, F.lit('"another"')).otherwise(F.col("tag"))
    since = F.when(page % 10 == 0, F.lit(None)).otherwise(F.col("stored"))
    headers = F.map_filter(F.map_from_arrays(F.array(*[F.lit(x) for x in ("etag", "last-modified", "date", "expires", "content-length", "set-cookie")]), F.array(shown, since, later.cast("string"), F.lit("never"), F.lit("0"), F.lit("a=b"))), lambda k, v: v.isNotNull())
    revisit = base.select((page * 2 + 1).alias("record_id"), F.concat(F.col("url"), F.lit("#top")).alias("url"), later.alias("ts"), F.lit(304).alias("status"), headers.alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("int").alias("n_bytes"))
    return full.unionByName(revisit)


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All revisits of the archive derived from the whole ``pages`` table."""
    return resolve_revisits(archive_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))


ORACLE = """
WITH b AS (SELECT page_id, trim(regexp_replace(url, '#.*$', '')) AS u, md5(html) AS digest, strlen(html) AS n_bytes, '"' || substr(md5(html), 1, 16) || '"' AS tag,
  (DATE '1970-01-01' + ((1700000000 + page_id % 977 * 86400) // 86400)::INTEGER)::DATE::VARCHAR AS stored, 1710000000 + page_id % 5 * 600 AS t_at FROM pages),
p AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) AS host,
  regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(/[^?]*)?', 1), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '')), '&') AS query FROM b),
c AS (SELECT *, CASE WHEN scheme <> '' THEN scheme || '://' || CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
  || path || CASE WHEN coalesce(query, '') <> '' THEN '?' || query ELSE '' END ELSE u END AS url,
  t_at + CASE WHEN page_id % 13 = 0 THEN -4000 ELSE page_id % 7 * 300 END AS later FROM p),
v AS (SELECT page_id * 2 + 1 AS record_id, url, later AS ts, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'W/' || tag WHEN 2 THEN '"another"' ELSE tag END AS tag, CASE WHEN page_id % 10 = 0 THEN NULL ELSE stored END AS since FROM c),
j AS (SELECT v.*, r.page_id * 2 AS response_id, r.tag AS r_tag, r.stored AS r_stored, r.digest AS r_digest, r.n_bytes AS r_bytes, r.t_at AS r_at,
  row_number() OVER (PARTITION BY v.record_id ORDER BY r.t_at DESC NULLS LAST, r.page_id DESC) AS no FROM v LEFT JOIN c r ON r.url = v.url AND r.t_at < v.ts),
o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'unmatched' WHEN tag IS NULL AND since IS NULL THEN 'unchecked'
  WHEN CASE WHEN tag IS NOT NULL THEN regexp_replace(tag, '^W/', '') = r_tag ELSE since = r_stored END THEN 'resolved' ELSE 'changed' END AS outcome FROM j WHERE no = 1)
SELECT record_id, url, outcome, response_id, CASE WHEN outcome = 'resolved' THEN r_digest END AS digest, CASE WHEN outcome = 'resolved' THEN r_bytes::BIGINT END AS n_bytes,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || r_bytes || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10)
    || 'etag: ' || coalesce(tag, r_tag) || chr(10) || 'expires: never' || chr(10) || 'last-modified: ' || r_stored END AS headers FROM o
"""
