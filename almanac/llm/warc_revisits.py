"""Resolution of not-modified revisits in web archives.

A revisit record (the server answered 304) has no body: it stands for the latest earlier full
response of the same canonical URL. ``resolve`` finds that response with an as-of join, checks the
validators the revisit was made with (ETag if there is one, compared weakly, else Last-Modified)
and merges the headers that a 304 may update into those of the response.

The as-of join never brings a URL's records together in one task: time is cut into buckets, a window
over (URL, bucket) finds earlier responses inside the bucket, and a small table with the latest
response of each (URL, bucket) carries it into the later ones; that table is itself cut by coarser
buckets, so its windows are bounded too. Bodies don't move: only ids, validators and headers do.

Records: record_id, warc_type (response or revisit), target_uri, warc_date, status, headers (lines
"Name: value"), payload_digest. Other columns are ignored.

Defined results: a null URL matches nothing; a null date is before all others for a response and
matches nothing for a revisit; of responses with one date the largest record_id counts; a response
must be strictly earlier; rows with a null type or status other than 200 are no full responses;
repeated records give repeated rows; a null record_id is as any other and before all of them; null
headers are empty; dates count in microseconds; no records give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.util import materialize

#: Headers that a 304 response may update. Fixed values.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't choose the resource.
TRACKING = "ref|fbclid|gclid|utm_[a-z]+"
#: A bucket of time in microseconds, and buckets of a coarser one.
BUCKET, COARSE = 3_600_000_000, 1024


def canonical_url(url: Column) -> Column:
    """Without scheme, "www.", fragment, tracking parameters and final slash; host in lower case;
    parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www\\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "^[^?]*\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def header_map(block: Column) -> Column:
    """Names in lower case; of a repeated name the last line counts."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def header_text(headers: Column) -> Column:
    """Sorted lines "name: value"."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def merged(response: Column, revisit: Column) -> Column:
    """The response's headers, updated by the revisit's permitted ones."""
    update = F.map_filter(revisit, lambda k, _: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(response, lambda k, _: ~F.coalesce(F.map_contains_key(update, k), F.lit(False))), update)


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def latest_before(rows: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Adds ``prior``: the greatest non-null ``value`` (a struct that starts with its time) of rows
    of the same ``key`` with a smaller ``time`` (microseconds). Time buckets bound every window."""
    rows = rows.withColumn("__b", F.floor(F.col(time) / BUCKET))
    inside = Window.partitionBy(key, "__b").orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.max(value).over(inside))
    bucket = rows.groupBy(key, "__b").agg(F.max(value).alias("__last")).withColumn("__c", F.floor(F.col("__b") / COARSE))
    earlier = Window.partitionBy(key, "__c").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bucket = bucket.withColumn("__near", F.max("__last").over(earlier))
    coarse = bucket.groupBy(key, "__c").agg(F.max("__last").alias("__far"))
    coarse = coarse.withColumn("__far", F.max("__far").over(Window.partitionBy(key).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)))
    carry = bucket.join(coarse, [key, "__c"]).select(key, "__b", F.coalesce("__near", "__far").alias("__carry"))
    return rows.join(carry, [key, "__b"], "left").withColumn("prior", F.coalesce("__own", "__carry")).drop("__b", "__own", "__carry")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit record: record_id, canonical_url, response_id, outcome (resolved,
    stale_validator, no_validator or no_response), headers (merged where resolved, else the
    revisit's own) and payload_digest (where resolved)."""
    r = records.select(
        "record_id", "warc_type", canonical_url(F.col("target_uri")).alias("url"),
        F.unix_micros(F.col("warc_date").cast("timestamp")).alias("t"), "status", header_map(F.col("headers")).alias("h"), "payload_digest", F.monotonically_increasing_id().alias("row"),
    )
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    r = materialize(r.where("warc_type = 'revisit' or (warc_type = 'response' and status = 200)"), "records")
    time = F.coalesce(F.col("t"), F.when(full, F.lit(-(1 << 60))))
    timed = r.withColumn("t", time).where("url is not null and t is not null")
    value = F.struct("t", F.col("record_id").alias("id"), F.col("h").getItem("etag").alias("etag"), F.col("h").getItem("last-modified").alias("modified"), F.col("payload_digest").alias("digest"), "row")
    found = latest_before(timed.select("row", "warc_type", "url", "t", F.when(full, value).alias("v")), "url", "t", "v")
    matched = found.where("warc_type = 'revisit'").select("row", "prior.id", "prior.etag", "prior.modified", "prior.digest", F.col("prior.row").alias("source"))
    revisits = r.where("warc_type = 'revisit'").select("record_id", F.col("url").alias("canonical_url"), "h", "row")
    responses = r.where(full).select(F.col("row").alias("source"), F.col("h").alias("full"))
    out = revisits.join(matched, "row", "left").join(responses, "source", "left")
    tag, date = F.col("h").getItem("etag"), F.col("h").getItem("last-modified")
    outcome = (
        F.when(F.col("source").isNull(), "no_response")
        .when(tag.isNotNull(), F.when(weak(tag).eqNullSafe(weak(F.col("etag"))), "resolved").otherwise("stale_validator"))
        .when(date.isNotNull(), F.when(date.eqNullSafe(F.col("modified")), "resolved").otherwise("stale_validator"))
        .otherwise("no_validator")
    )
    out = out.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    return out.select(
        "record_id", "canonical_url", F.col("id").alias("response_id"), "outcome",
        header_text(F.when(good, merged(F.col("full"), F.col("h"))).otherwise(F.col("h"))).alias("headers"),
        F.when(good, F.col("digest")).alias("payload_digest"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records that Spark derives from ``pages``: for each page a full response with ETag,
    Last-Modified, Cache-Control and Content-Type, for every third one a changed response twelve
    hours later, and a revisit a day later under another spelling of the URL; of the revisits every
    fifth has the validator of another version, every seventh only Last-Modified, every eleventh
    none."""
    p = pages.select("page_id", "url", F.md5(F.coalesce(F.col("html"), F.lit(""))).alias("md5"))
    stamp = lambda hours: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60 + F.lit(3600 * hours))
    k = F.col("page_id")
    day = F.concat(F.lit("day "), (F.floor(k / 1440) + 1).cast("string"))

    def record(kind: str, n: int, hours: int, url: Column, status: int, headers: Column, digest: Column) -> DataFrame:
        return p.select(
            (k * 3 + n).alias("record_id"), F.lit(kind).alias("warc_type"), url.alias("target_uri"), stamp(hours).alias("warc_date"),
            F.lit(status).alias("status"), headers.alias("headers"), digest.alias("payload_digest"),
        )

    def response(tag: Column) -> Column:
        return F.concat(F.lit('HTTP-Version: 1.1\r\nETag: "'), tag, F.lit('"\r\nLast-Modified: '), day, F.lit("\r\nCache-Control: max-age=60\r\nContent-Type: text/html"))

    first = record("response", 0, 0, F.col("url"), 200, response(F.col("md5")), F.col("md5"))
    second_tag = F.md5(F.concat(F.col("md5"), F.lit("2")))
    second = record("response", 1, 12, F.col("url"), 200, response(second_tag), second_tag).where(F.col("record_id") % 9 == 1)
    current = F.when(k % 3 == 0, second_tag).otherwise(F.col("md5"))
    sent = F.when(k % 5 == 0, F.lit("other")).otherwise(current)
    validator = F.when(k % 11 == 0, F.lit("")).when(k % 7 == 0, F.concat(F.lit("\r\nLast-Modified: "), day)).otherwise(F.concat(F.lit('\r\nETag: W/"'), sent, F.lit('"')))
    spelling = F.concat(F.lit("HTTPS://www."), F.regexp_replace(F.col("url"), "^[a-z]+://(www\\.)?", ""), F.lit("#again"))
    headers = F.concat(F.lit("Date: later\r\nCache-Control: no-cache\r\nContent-Length: 0"), validator)
    revisit = record("revisit", 2, 24, spelling, 304, headers, F.lit(None).cast("string"))
    return first.unionByName(second).unionByName(revisit)
