"""Not-modified revisit records of web archives, resolved by an as-of join.

A revisit of the server-not-modified kind has no body: its page is the latest earlier full
response of the same canonical URL. Its validators are checked against that response (the
entity tag by weak comparison; the modification date where the revisit has no tag), and the
stored headers are updated with those that a 304 response may carry.

The join orders records by time within a URL. It works in time buckets: within a bucket by a
running window, across buckets by the last response of each earlier bucket, so that a URL
with very many captures is spread over tasks. Bodies aren't touched; they are fetched by
record id afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified response must not change in a stored one, in lower case. Fixed values.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
BUCKET_SECONDS = 6 * 3600


def canonical_url(url: Column) -> Column:
    """One spelling for URLs of one page: no scheme, user, ``www`` label, default port, fragment,
    tracking parameters, index page or closing slash; host in lower case, parameters in order.
    Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^[^@]*@", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/index\.(html?|php)$", "/"), r"/+$", "")
    given = F.split(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|fbclid|gclid|ref|sessionid|phpsessid)=")))
    return F.concat(F.regexp_replace(host, r"^www[0-9]*\.", ""), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _header(name: str, headers: str = "headers") -> Column:
    """A header by its name in any case; with several spellings the first in order."""
    found = F.filter(F.array_sort(F.map_entries(headers)), lambda e: F.lower(e["key"]) == name)
    return F.try_element_at(found, F.lit(1))["value"]


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^[Ww]/", "")


def _lowered(headers: Column) -> Column:
    """Header entries with lower-case names, the first of equal names."""
    entries = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.transform(names, lambda n: F.struct(n.alias("key"), F.try_element_at(F.filter(entries, lambda e: e["key"] == n), F.lit(1))["value"].alias("value")))


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per revisit of ``records``: its own columns and what it resolves to.

    ``records``: record_id, kind ('response' or 'revisit'), url, captured (timestamp), status,
    headers (map), payload_digest. Full responses are those with status 200. Result: record_id,
    canonical_url, captured, outcome, matched_id, matched_at, status, headers (merged map,
    lower-case names), payload_digest.

    ``outcome``: 'resolved' (validators agree), 'unchecked' (the revisit or the response has
    none to compare), 'mismatch' (they differ: nothing is merged) or 'orphan' (no earlier full
    response, or a null URL or time). Earlier means a smaller time, not an equal one; of
    responses at one time the largest record id counts. Repeated revisits give a row each.
    Null header maps count as empty. Further columns are ignored.
    """
    r = records.select(
        "record_id",
        "kind",
        canonical_url(F.col("url")).alias("canonical_url"),
        "captured",
        "status",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        "payload_digest",
    ).withColumn("bucket", F.floor(F.col("captured").cast("timestamp").cast("long") / bucket_seconds))
    keyed = F.col("canonical_url").isNotNull() & F.col("captured").isNotNull()
    response = F.struct("captured", "record_id", _header("etag").alias("etag"), _header("last-modified").alias("modified"), "status", "headers", "payload_digest")
    full = r.where(keyed & (F.col("kind") == "response") & (F.col("status") == 200)).select("canonical_url", "bucket", "captured", response.alias("full"))
    revisits = r.where(F.col("kind") == "revisit")

    last = full.groupBy("canonical_url", "bucket").agg(F.max_by("full", F.struct(F.col("full.captured"), F.col("full.record_id"))).alias("full"))
    asked = revisits.where(keyed).select("canonical_url", "bucket").distinct().withColumn("full", F.lit(None).cast(last.schema["full"].dataType))
    before = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = last.unionByName(asked).groupBy("canonical_url", "bucket").agg(F.max_by("full", F.col("full.captured")).alias("full"))
    carried = heads.select("canonical_url", "bucket", F.last("full", ignorenulls=True).over(before).alias("carried"))

    events = revisits.where(keyed).withColumn("full", F.lit(None).cast(last.schema["full"].dataType)).unionByName(
        full.select("canonical_url", "bucket", "captured", "full", F.col("full.record_id").alias("record_id")), allowMissingColumns=True
    )
    running = Window.partitionBy("canonical_url", "bucket").orderBy("captured", F.col("full").isNotNull(), "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = events.withColumn("found", F.last("full", ignorenulls=True).over(running)).where(F.col("full").isNull()).drop("full")
    matched = inside.join(carried, ["canonical_url", "bucket"], "left").withColumn("found", F.coalesce("found", "carried")).drop("carried")
    unkeyed = revisits.where(~keyed).withColumn("found", F.lit(None).cast(last.schema["full"].dataType))
    asof = matched.unionByName(unkeyed)

    etag, modified = _header("etag"), _header("last-modified")
    outcome = (
        F.when(F.col("found").isNull(), "orphan")
        .when(etag.isNotNull() & F.col("found.etag").isNotNull(), F.when(_weak(etag) == _weak(F.col("found.etag")), "resolved").otherwise("mismatch"))
        .when(modified.isNotNull() & F.col("found.modified").isNotNull(), F.when(F.trim(modified) == F.trim(F.col("found.modified")), "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    new = F.filter(_lowered(F.col("headers")), lambda e: ~e["key"].isin(*KEPT_HEADERS))
    old = _lowered(F.col("found.headers"))
    names = F.transform(new, lambda e: e["key"])
    merged = F.map_from_entries(F.array_sort(F.concat(F.filter(old, lambda e: ~F.array_contains(names, e["key"])), new)))
    good = F.col("outcome").isin("resolved", "unchecked")
    return asof.withColumn("outcome", outcome).select(
        "record_id",
        "canonical_url",
        "captured",
        "outcome",
        F.when(good, F.col("found.record_id")).alias("matched_id"),
        F.when(good, F.col("found.captured")).alias("matched_at"),
        F.when(good, F.col("found.status")).alias("status"),
        F.when(good, merged).alias("headers"),
        F.when(good, F.col("found.payload_digest")).alias("payload_digest"),
    )


def records_of(pages: DataFrame) -> DataFrame:
    """Archive records that a crawl of ``pages`` could have left.

    Every page is a full response at a time that its id sets. Every page is visited again, under
    another scheme and fragment, with a 304: one in five with another entity tag, one in seven
    with the date alone, one in eleven before the first capture. One page in three is captured in
    full once more, changed, between the two.
    """
    day = F.lit("2024-01-01 00:00:00").cast("timestamp")

    def at(seconds: Column) -> Column:
        return F.timestamp_seconds(F.unix_timestamp(day) + seconds)

    first = (F.col("page_id") * 7919) % 2_000_000 + 400_000
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    base = pages.select("page_id", "url", first.alias("first"), digest.alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("bytes"))

    def date(seconds: Column) -> Column:
        return F.date_format(at(seconds), "yyyy-MM-dd HH:mm:ss")

    def full(number: int, seconds: Column, mark: str) -> DataFrame:
        tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit(mark), F.lit('"'))
        headers = F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), date(seconds - 3600), F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("bytes"), F.lit("Cache-Control"), F.lit("max-age=60"))
        return base.select((F.col("page_id") * 4 + number).alias("record_id"), F.lit("response").alias("kind"), "url", at(seconds).alias("captured"), F.lit(200).alias("status"), headers.alias("headers"), F.concat("digest", F.lit(mark)).alias("payload_digest"), "page_id")

    again = F.when(F.col("page_id") % 11 == 0, F.col("first") - 300_000).otherwise(F.col("first") + 300_000)
    changed = F.col("page_id") % 3 == 0
    mark = F.when(F.col("page_id") % 5 == 0, "z").when(changed, "b").otherwise("")
    validators = F.when(
        F.col("page_id") % 7 == 0, F.create_map(F.lit("last-modified"), date(F.when(changed, F.col("first") + 150_000).otherwise(F.col("first")) - 3600))
    ).otherwise(F.create_map(F.lit("etag"), F.concat(F.lit('W/"'), F.substring("digest", 1, 16), mark, F.lit('"'))))
    more = F.create_map(F.lit("Date"), date(again), F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Content-Length"), F.lit("0"))
    other = F.concat(F.regexp_replace(F.regexp_replace("url", r"^https?://", F.when(F.col("url").startswith("https:"), "http://").otherwise("https://")), r"#.*$", ""), F.lit("#seen"))
    revisit = base.select((F.col("page_id") * 4 + 2).alias("record_id"), F.lit("revisit").alias("kind"), other.alias("url"), at(again).alias("captured"), F.lit(304).alias("status"), F.map_concat(validators, more).alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    return full(0, F.col("first"), "").drop("page_id").unionByName(full(1, F.col("first") + 150_000, "b").where("page_id % 3 = 0").drop("page_id")).unionByName(revisit)


def resolved_pages(pages: DataFrame) -> DataFrame:
    """The query's digest columns: headers as sorted ``name: value`` lines."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return resolve(records_of(pages)).select(
        "record_id", "canonical_url", F.unix_timestamp("captured").alias("captured_s"), "outcome", "matched_id", F.unix_timestamp("matched_at").alias("matched_s"), "status", lines.alias("headers"), "payload_digest"
    )


ORACLE = r"""
WITH base AS (
  SELECT page_id, url, (page_id * 7919) % 2000000 + 400000 AS first, md5(coalesce(html, '')) AS digest,
         strlen(coalesce(html, ''))::VARCHAR AS bytes, 1704067200 AS day
  FROM pages
), full0 AS (
  SELECT *, page_id * 4 AS record_id, first AS s, '' AS mark FROM base
  UNION ALL
  SELECT *, page_id * 4 + 1, first + 150000, 'b' FROM base WHERE page_id % 3 = 0
), canon AS (
  SELECT url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM (SELECT DISTINCT url FROM base)
), named AS (
  SELECT url,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '')
    || regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/index\.(html?|php)$', '/'), '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'),
                lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid|ref|sessionid|phpsessid)='))) AS kept FROM canon)
), response AS (
  SELECT canonical_url, record_id, day + s AS captured_s, '"' || substr(digest, 1, 16) || mark || '"' AS etag,
         strftime(make_timestamp((day + s - 3600)::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') AS modified, bytes, digest || mark AS payload_digest
  FROM full0 JOIN named USING (url)
), revisit AS (
  SELECT page_id, canonical_url, page_id * 4 + 2 AS record_id, day + CASE WHEN page_id % 11 = 0 THEN first - 300000 ELSE first + 300000 END AS captured_s,
         CASE WHEN page_id % 7 <> 0 THEN '"' || substr(digest, 1, 16) || CASE WHEN page_id % 5 = 0 THEN 'z' WHEN page_id % 3 = 0 THEN 'b' ELSE '' END || '"' END AS etag,
         CASE WHEN page_id % 7 = 0 THEN strftime(make_timestamp((day + CASE WHEN page_id % 3 = 0 THEN first + 150000 ELSE first END - 3600)::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') END AS modified
  FROM base JOIN named USING (url)
), matched AS (
  SELECT v.*, f.record_id AS fid, f.captured_s AS fs, f.etag AS fetag, f.modified AS fmod, f.bytes, f.payload_digest,
         row_number() OVER (PARTITION BY v.record_id ORDER BY f.captured_s DESC, f.record_id DESC) AS k
  FROM revisit v LEFT JOIN response f ON v.canonical_url = f.canonical_url AND f.captured_s < v.captured_s
), judged AS (
  SELECT *, CASE WHEN fid IS NULL THEN 'orphan' WHEN etag IS NOT NULL THEN CASE WHEN etag = fetag THEN 'resolved' ELSE 'mismatch' END
                 WHEN modified = fmod THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM matched WHERE k = 1
)
SELECT record_id, canonical_url, captured_s, outcome,
       CASE WHEN outcome = 'resolved' THEN fid END AS matched_id,
       CASE WHEN outcome = 'resolved' THEN fs END AS matched_s,
       CASE WHEN outcome = 'resolved' THEN 200 END AS status,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || bytes || chr(10) || 'content-type: text/html' || chr(10) ||
         'date: ' || strftime(make_timestamp(captured_s::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') || chr(10) ||
         'etag: ' || CASE WHEN etag IS NOT NULL THEN 'W/' || etag ELSE fetag END || chr(10) ||
         'last-modified: ' || CASE WHEN modified IS NOT NULL THEN modified ELSE fmod END END AS headers,
       CASE WHEN outcome = 'resolved' THEN payload_digest END AS payload_digest
FROM judged
"""
