"""WARC revisit resolution: not-modified records get the content and headers of the response they point at.

A revisit joins, as of its date, the latest earlier full response of the same canonical URL. It is resolved if the
validators agree: the entity tags (compared weakly) if both records have one, else the modification dates if both have
one, else the payload digests. The headers of a resolved revisit are those of the response, overlaid with the ones that a
not-modified answer may update (``PERMITTED``).

The join is no join: both kinds of record are sorted by (URL, date, id) over range partitions, so records of one hot URL
spread over many tasks. Within a partition a window finds the latest response; what a URL's earlier partitions hand on is
a row for each URL that spans partitions (two for each partition at most), broadcast if they are ``max_broadcast`` bytes at most, else joined.
Payloads never move: records carry a digest and a length.

Defined results: a revisit without URL, date, or any earlier response is ``orphan``; one whose validators disagree or are
missing is ``mismatch`` (it keeps its own headers); records of one date are ordered by kind (responses first) and id, so a
response of the same date counts as earlier; null headers count as none; repeated rows are each resolved; empty tables
give empty results; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parsewarden.llm.common import checkpointed, table

#: What a 304 answer may carry to update a stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Scheme and www. dropped, host lower-cased without default port, query sorted without tracking, no fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(rf"^{TRACKING}(?:=|$)")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    """headers with lower-case names; of names that differ in case alone the last counts."""
    every = F.map_entries(headers)
    names = F.transform(every, lambda e: F.lower(e["key"]))
    last = F.filter(every, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), F.lower(e["key"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def merged_headers(stored: Column, update: Column) -> Column:
    """stored, with the permitted ones of update in place of its own. Both: map of lower-case names."""
    own = F.map_filter(F.coalesce(update, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(own), k) & v.isNotNull())
    return F.map_concat(kept, own)


def resolve_revisits(records: DataFrame, max_broadcast: int = 32 << 20) -> DataFrame:
    """One row for each revisit.

    records: record_id, kind (response or revisit), url, date, headers (map, names in any case), digest, length.
    Returns record_id, url_key, date, status, response_id, response_date, digest, length, headers.
    """
    own = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url_key"), "date", lower_names(F.col("headers")).alias("headers"), "digest", "length")
    lost = own.filter((F.col("kind") == "revisit") & (F.col("url_key").isNull() | F.col("date").isNull()))
    own = own.filter(F.col("url_key").isNotNull() & F.col("date").isNotNull() & F.col("kind").isin("response", "revisit"))
    order = ("date", "kind", "record_id")
    parts = checkpointed(own.repartitionByRange("url_key", *order).withColumn("part", F.spark_partition_id()))
    response = F.when(F.col("kind") == "response", F.struct("date", "record_id", "headers", "digest", "length"))
    # what each partition hands on, for URLs that span several
    ends = parts.groupBy("url_key", "part").agg(F.max_by(response, F.when(F.col("kind") == "response", F.struct("date", "record_id"))).alias("last"))
    spans = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(spans)).filter(F.col("carried").isNotNull()).select("url_key", "part", "carried")
    carried = checkpointed(carried)
    size = F.coalesce(F.sum(F.length(F.to_json(F.struct("url_key", "carried")))), F.lit(0))
    if carried.agg(size).first()[0] <= max_broadcast:
        carried = F.broadcast(carried)
    within = Window.partitionBy("url_key", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = parts.withColumn("latest", F.last(response, ignorenulls=True).over(within)).filter(F.col("kind") == "revisit")
    found = found.join(carried, ["url_key", "part"], "left").withColumn("r", F.coalesce("latest", "carried"))
    weak = lambda c: F.regexp_replace(F.try_element_at(c, F.lit("etag")), r"^W/", "")
    changed = lambda c: F.try_element_at(c, F.lit("last-modified"))
    agree = F.coalesce(weak("headers") == weak(F.col("r.headers")), changed("headers") == changed(F.col("r.headers")), F.col("digest") == F.col("r.digest"), F.lit(False))
    status = F.when(F.col("r").isNull(), "orphan").when(agree, "resolved").otherwise("mismatch")
    found = found.withColumn("status", status)
    fits = F.col("status") == "resolved"
    out = found.select("record_id", "url_key", "date", "status", F.when(fits, F.col("r.record_id")).alias("response_id"), F.when(fits, F.col("r.date")).alias("response_date"), F.when(fits, F.col("r.digest")).alias("digest"), F.when(fits, F.col("r.length")).alias("length"), F.when(fits, merged_headers(F.col("r.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"))
    none = lambda c: F.lit(None).cast(dict(out.dtypes)[c]).alias(c)
    return out.unionByName(lost.select("record_id", "url_key", "date", F.lit("orphan").alias("status"), none("response_id"), none("response_date"), none("digest"), none("length"), "headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl of the pages: each is a response, and visited again under another spelling of the URL.

    Times are seconds. Every fifth later visit has another entity tag, every seventh none but a modification date, and
    every eleventh precedes its page, so that it finds an earlier page of that URL or none.
    """
    k = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.sha2("html", 256), 1, 16), F.lit('"'))
    modified = F.concat(F.lit("day "), (k % 365).cast("string"))
    date = F.lit(1_000_000) + k * 100
    headers = lambda **kw: F.create_map(*[x for n, v in kw.items() for x in (F.lit(n.replace("_", "-")), v)])
    full = F.struct(F.concat(F.lit("page-"), k.cast("string")).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("url"), date.alias("date"), headers(content_type=F.lit("text/html"), etag=tag, last_modified=modified, cache_control=F.lit("max-age=60"), server=F.lit("one")).alias("headers"), F.sha2("html", 256).alias("digest"), F.length("html").cast("long").alias("length"))
    other = F.when(k % 5 == 0, F.lit('"other"')).when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("W/"), tag))
    again = F.struct(F.concat(F.lit("visit-"), k.cast("string")).alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.lit("#again")).alias("url"), (date + F.when(k % 11 == 0, -50).otherwise(50)).alias("date"), headers(etag=other, last_modified=modified, cache_control=F.lit("no-cache"), server=F.lit("two")).alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("length"))
    return pages.select(F.explode(F.array(full, again)).alias("r")).select("r.*")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))
    each = [F.try_element_at("headers", F.lit(h)).alias(h.replace("-", "_")) for h in ("content-type", "etag", "last-modified", "cache-control", "server")]
    return out.select("record_id", "url_key", "date", "status", "response_id", "response_date", "digest", "length", *each)


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, sha256(html) AS digest, length(html)::BIGINT AS length, 1000000 + page_id * 100 AS date,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS rest FROM pages
), k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS bare,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS q FROM p
), r AS (
  SELECT page_id, bare || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key, digest, length, date,
    '"' || digest[1:16] || '"' AS tag, 'day ' || (page_id % 365) AS modified FROM k
), v AS (
  SELECT page_id, url_key, date + CASE WHEN page_id % 11 = 0 THEN -50 ELSE 50 END AS date, modified,
    CASE WHEN page_id % 5 = 0 THEN '"other"' WHEN page_id % 7 = 0 THEN NULL ELSE 'W/' || tag END AS tag FROM r
), j AS (
  SELECT v.*, r.page_id AS rid, r.date AS rdate, r.digest, r.length, r.tag AS rtag, r.modified AS rmod
  FROM v ASOF LEFT JOIN r ON v.url_key = r.url_key AND v.date >= r.date
), s AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'orphan' WHEN coalesce(regexp_replace(tag, '^W/', '') = rtag, modified = rmod, false) THEN 'resolved' ELSE 'mismatch' END AS status FROM j
)
SELECT 'visit-' || page_id AS record_id, url_key, date, status, CASE WHEN status = 'resolved' THEN 'page-' || rid END AS response_id,
  CASE WHEN status = 'resolved' THEN rdate END AS response_date, CASE WHEN status = 'resolved' THEN digest END AS digest,
  CASE WHEN status = 'resolved' THEN length END AS length, CASE WHEN status = 'resolved' THEN 'text/html' END AS content_type,
  CASE WHEN status = 'resolved' THEN coalesce(tag, rtag) ELSE tag END AS etag, modified AS last_modified, 'no-cache' AS cache_control,
  CASE WHEN status = 'resolved' THEN 'one' ELSE 'two' END AS server
FROM s
"""
