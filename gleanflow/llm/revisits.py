"""Not-modified revisits of a crawl, resolved to the responses they stand for.

A revisit record says that the server called a page unchanged. It is joined as of its time to the latest full response
of the same canonical URL that is earlier. The validators must agree: an ETag against the ETag, else Last-Modified
against Last-Modified, and a payload digest against the digest, each where the revisit has one. Then the record
takes over the response's payload and headers, and of its own headers those that a 304 may update.

Records are range-partitioned by URL, time and kind, so a URL may own any share of them. The last response of
each partition and URL is carried over to later partitions, of which each URL has few rows. Payloads are
joined last.

Outcomes: ``response`` for full responses; ``resolved``; ``no_response`` if no earlier full response exists;
``etag``, ``last_modified`` or ``digest`` for the first validator that differs. Only resolved revisits get a payload.

Defined cases: a null URL never resolves; a null time sorts first, and a revisit needs an earlier response, not one of the
same time; of responses of equal time the one with the greatest id counts; ids are unique by contract and not null, repeated ids
share the first payload; header names are matched without case; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanflow.functions.urls import canonical_url
from gleanflow.llm.common import ordered, staged, table
from gleanflow.plans.oracles import PAGE_URI

# The header fields that a 304 response may carry for an update (RFC 9110, 15.4.5; RFC 9111, 3.2).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "via", "warning")

RECORD = "record_id long, url string, at timestamp, kind string, headers map<string,string>, digest string, payload string"


def lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then meet, the last one stays."""
    return F.aggregate(
        F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
        F.create_map().cast("map<string,string>"),
        lambda done, entry: F.map_concat(
            F.map_filter(done, lambda k, _: k != F.lower(entry["key"])),
            F.map_from_arrays(F.array(F.lower(entry["key"])), F.array(entry["value"])),
        ),
    )


def canonical(url: Column) -> Column:
    """The library's canonical form without fragment, or the text itself where that has none."""
    return F.coalesce(F.regexp_replace(canonical_url(url)["uri"], "#.*$", ""), url)


def resolve(records: DataFrame) -> DataFrame:
    """``record_id, canonical, at, kind, outcome, refers_to, headers, payload`` for every record (``RECORD``)."""
    narrow = records.select(
        "record_id",
        canonical(F.col("url")).alias("canonical"),
        "at",
        "kind",
        lowered(F.col("headers")).alias("headers"),
        "digest",
    )
    # Stored once: the range partitioning looks at its rows twice.
    narrow = staged(narrow)
    full = F.col("kind") == "response"
    # Revisits come before responses of their time: these are not earlier.
    rows = ordered(
        narrow.withColumn("_full", full.cast("int")),
        F.col("canonical"), F.col("at").asc_nulls_first(), F.col("_full"), F.col("record_id"),
    )
    found = F.when(full, F.struct("record_id", "at", "headers", "digest"))
    inside = Window.partitionBy("_pid", "canonical").orderBy("_idx")
    rows = rows.withColumn("_near", F.last(found, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    # The last response of each URL in each partition, and what earlier partitions hand on.
    last = F.max_by(found, F.when(full, F.col("_idx"))).alias("_last")
    ends = rows.where(F.col("canonical").isNotNull()).groupBy("_pid", "canonical").agg(last)
    before = Window.partitionBy("canonical").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_pid", "canonical", F.last("_last", ignorenulls=True).over(before).alias("_far"))
    carried = carried.where(F.col("_far").isNotNull())
    rows = rows.join(carried, ["_pid", "canonical"], "left")
    base = F.coalesce("_near", "_far")
    rows = rows.withColumn("_base", F.when(~full & F.col("canonical").isNotNull(), base))
    own, of = F.col("headers"), F.col("_base.headers")

    def differs(name: str) -> Column:
        return own[name].isNotNull() & ~own[name].eqNullSafe(of[name])

    outcome = (
        F.when(full, "response")
        .when(F.col("_base").isNull() | F.col("at").isNull(), "no_response")
        .when(differs("etag"), "etag")
        .when(own["etag"].isNull() & differs("last-modified"), "last_modified")
        .when(F.col("digest").isNotNull() & ~F.col("digest").eqNullSafe(F.col("_base.digest")), "digest")
        .otherwise("resolved")
    )
    rows = rows.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    updates = F.map_filter(own, lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(of, lambda k, _: ~F.array_contains(F.map_keys(updates), k))
    rows = rows.select(
        "record_id", "canonical", "at", "kind", "outcome",
        F.when(good, F.col("_base.record_id")).alias("refers_to"),
        F.when(good, F.map_concat(kept, updates)).otherwise(own).alias("headers"),
        F.when(full, F.col("record_id")).when(good, F.col("_base.record_id")).alias("_body"),
    )
    # Records without a payload get keys of their own, or they would all gather in one place.
    with_body = F.concat(F.lit("r"), F.col("_body").cast("string"))
    rows = rows.withColumn("_key", F.coalesce(with_body, F.concat(F.lit("n"), F.col("record_id").cast("string"))))
    bodies = records.where(full).select(F.concat(F.lit("r"), F.col("record_id").cast("string")).alias("_key"), "payload")
    return rows.join(bodies.dropDuplicates(["_key"]), "_key", "left").drop("_key", "_body")


def crawl(pages: DataFrame) -> DataFrame:
    """Records of a crawl of the whole table: every page as a response and, a while later, as a revisit.

    A page is fetched ``page_id`` minutes into the crawl. Seven in eight revisits carry the validators of
    their page; the others an ETag, a date or a digest of something else. Every fifth revisit precedes its page.
    """
    start, minute = F.lit("2024-01-01").cast("timestamp"), F.expr("interval 1 minute")
    at = start + F.col("page_id") * minute
    etag, digest = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"')), F.sha1("html")
    date = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        at.alias("at"),
        F.lit("response").alias("kind"),
        F.create_map(
            F.lit("ETag"), etag, F.lit("Last-Modified"), date, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), date
        ).alias("headers"),
        digest.alias("digest"),
        F.col("html").alias("payload"),
    )
    odd = F.pmod("page_id", F.lit(24))
    late = F.when(F.pmod("page_id", F.lit(5)) == 0, F.expr("interval -90 seconds")).otherwise(F.expr("interval 30 seconds"))
    seen = F.date_format(at + late, "yyyy-MM-dd HH:mm:ss")
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        F.col("url"),
        (at + late).alias("at"),
        F.lit("revisit").alias("kind"),
        F.map_filter(
            F.create_map(
                F.lit("etag"), F.when(odd == 1, F.lit('"other"')).when(odd == 2, None).otherwise(etag),
                F.lit("last-modified"), F.when(odd == 2, "1999-01-01 00:00:00").otherwise(date),
                F.lit("date"), seen, F.lit("Content-Type"), F.lit("text/plain"),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("headers"),
        F.when(odd == 3, F.sha1("url")).otherwise(digest).alias("digest"),
        F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


def op5_warc_revisits(spark, sf_dir):
    """Every record of the crawl with its outcome; payloads as digest and length."""
    found = resolve(crawl(table(spark, sf_dir, "pages")))
    entries = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select(
        "record_id",
        F.expr("record_id div 2").alias("page_id"),
        F.col("canonical").alias("url"),
        F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"),
        "kind",
        "outcome",
        "refers_to",
        F.array_join(entries, "\n").alias("headers"),
        F.sha1("payload").alias("payload_sha1"),
        F.length("payload").cast("long").alias("payload_chars"),
    )


# The crawl from the pages themselves, and each revisit's base as the best of all earlier responses of its address.
OP5_SQL = f"""
with r as (
  select page_id as p, url, html, {PAGE_URI} as uri, timestamp '2024-01-01' + to_minutes(page_id) as moment, sha1(html) as digest,
    '"' || left(md5(html), 16) || '"' as etag, strftime(timestamp '2024-01-01' + to_minutes(page_id), '%Y-%m-%d %H:%M:%S') as date
  from pages
), v as (
  select p, uri, moment + case when p % 5 = 0 then interval (-90) second else interval 30 second end as seen,
    case p % 24 when 1 then '"other"' when 2 then null else etag end as etag, case p % 24 when 2 then '1999-01-01 00:00:00' else date end as modified,
    case p % 24 when 3 then sha1(url) else digest end as digest
  from r
), based as (
  select v.p, arg_max(r.p, {{'m': r.moment, 'p': r.p}}) as base from v join r on r.uri = v.uri and r.moment < v.seen group by v.p
), told as (
  select v.*, o.p as base, o.html, case when o.p is null then 'no_response' when v.etag <> o.etag then 'etag'
    when v.etag is null and v.modified <> o.date then 'last_modified' when v.digest <> o.digest then 'digest' else 'resolved' end as outcome, o.etag as old_etag
  from v left join based using (p) left join r as o on o.p = based.base
)
select 2 * p as record_id, p as page_id, uri as url, date as "at", 'response' as kind, 'response' as outcome, null::bigint as refers_to,
  'content-type: text/html' || chr(10) || 'date: ' || date || chr(10) || 'etag: ' || etag || chr(10) || 'last-modified: ' || date as headers,
  sha1(html) as payload_sha1, length(html) as payload_chars
from r
union all
select 2 * p + 1, p, uri, strftime(seen, '%Y-%m-%d %H:%M:%S'), 'revisit', outcome, case when outcome = 'resolved' then 2 * base end,
  'content-type: text/' || case when outcome = 'resolved' then 'html' else 'plain' end || chr(10) || 'date: ' || strftime(seen, '%Y-%m-%d %H:%M:%S')
    || coalesce(chr(10) || 'etag: ' || coalesce(etag, case when outcome = 'resolved' then old_etag end), '') || chr(10) || 'last-modified: ' || modified,
  case when outcome = 'resolved' then sha1(html) end, case when outcome = 'resolved' then length(html) end
from told
"""
