"""Not-modified revisits of web archives: an as-of join to the full responses.

A revisit record says that a URL had not changed. Its content is the latest earlier full
response of the same canonical URL, provided that the validators agree. The join looks
back in two steps: within a span of time of one URL, and over one row per span for what
lies further back. So the captures of a URL that is a third of the archive are spread
over as many tasks as it has spans. Bodies stay where they are; only record numbers,
times and validators are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragassay.llm.common import durable

#: seconds of a span
SPAN = 86_400
#: headers that a not-modified answer may bring up to date. Fixed values of HTTP.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
_TRACKING = "utm_[a-z]+|gclid|fbclid"


def canonical(url: Column | str) -> Column:
    """Host in lower case without www. and default port, path without closing slash, query
    without tracking parameters; scheme and fragment do not count. A null stays null."""
    url = F.col(url) if isinstance(url, str) else url
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/$", "")
    query = F.regexp_replace(F.regexp_extract(rest, "[?](.*)$", 1), rf"(^|&)({_TRACKING})=[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _weak(etag: Column) -> Column:
    """Entity tags compare without their weakness mark."""
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """Resolve every not-modified revisit.

    records: record_id (unique), url, ts (seconds), kind ('response' or 'revisit'), etag,
    last_modified, headers (map of lower-case names). One row per revisit: record_id, url
    (canonical), ts, response_id, state, headers. state is 'resolved', 'no response'
    (nothing full and strictly earlier at this URL), 'no validator' (the two have none in
    common) or 'changed' (entity tags differ, or without common tags the dates do);
    response_id and headers are null unless resolved. Of responses at one time the
    largest record_id counts. Headers are those of the response, brought up to date by
    the revisit's permitted ones. Records without url or ts, revisits included, have
    state 'no response'; other kinds and null kinds are left out. Repeated revisit rows
    are resolved as often as they come. An empty table gives an empty result; further
    columns are not read.
    """
    columns = ["record_id", "ts", "kind", "etag", "last_modified", "headers"]
    rows = records.filter("kind in ('response', 'revisit')").select(*columns, canonical("url").alias("url"))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id"))
    times = rows.filter("url is not null and ts is not null").select(
        "url", "ts", "record_id", "kind", full.alias("full"), F.floor(F.col("ts") / span).alias("span")
    )
    spans = times.groupBy("url", "span").agg(F.max("full").alias("last"))
    past = Window.partitionBy("url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = durable(spans.select("url", "span", F.max("last").over(past).alias("before")))
    earlier = Window.partitionBy("url", "span").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    within = times.select("url", "ts", "span", "kind", "record_id", F.max("full").over(earlier).alias("near"))
    found = within.filter("kind = 'revisit'").join(spans, ["url", "span"])
    found = durable(
        found.select("record_id", F.coalesce("near", "before").alias("of")).select("record_id", "of.record_id")
        .toDF("record_id", "response_id").filter("response_id is not null").distinct()
    )
    responses = rows.filter("kind = 'response'").select(
        F.col("record_id").alias("response_id"),
        F.col("etag").alias("r_etag"),
        F.col("last_modified").alias("r_modified"),
        F.col("headers").alias("r_headers"),
    )
    matched = (
        rows.filter("kind = 'revisit'")
        .join(found, "record_id", "left")
        .join(responses, "response_id", "left")
    )
    tags = F.col("etag").isNotNull() & F.col("r_etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("r_modified").isNotNull()
    state = (
        F.when(F.col("response_id").isNull(), "no response")
        .when(tags & (_weak(F.col("etag")) == _weak(F.col("r_etag"))), "resolved")
        .when(tags, "changed")
        .when(dates & (F.col("last_modified") == F.col("r_modified")), "resolved")
        .when(dates, "changed")
        .otherwise("no validator")
    )
    none = F.create_map().cast("map<string,string>")
    fresh = F.map_filter(F.coalesce("headers", none), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce("r_headers", none), lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    good = state == "resolved"
    return matched.select(
        "record_id",
        "url",
        "ts",
        F.when(good, F.col("response_id")).alias("response_id"),
        state.alias("state"),
        F.when(good, F.map_concat(kept, fresh)).alias("headers"),
    )


def archive(pages: DataFrame) -> DataFrame:
    """Records of an archive derived from all rows of pages: each page as a full response
    and two revisits, hours and days later, with changed, weak, missing or equal validators."""
    n = F.col("page_id")
    start = F.pmod(n * 7919, F.lit(2_592_000))
    digest = F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 12)
    day = F.concat(F.lit("day "), F.floor(start / 86_400).cast("string"))

    def record(i: int, kind: str, ts: Column, etag: Column, modified: Column, headers: list) -> Column:
        return F.struct(
            (n * 3 + i).alias("record_id"),
            F.lit(kind).alias("kind"),
            ts.cast("bigint").alias("ts"),
            etag.cast("string").alias("etag"),
            modified.cast("string").alias("last_modified"),
            F.create_map(*headers).alias("headers"),
        )

    text = F.lit("text/html")
    none = F.lit(None)
    full = record(
        0, "response", start, F.when(n % 5 > 0, digest), day,
        [F.lit("content-type"), text, F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string"),
         F.lit("date"), start.cast("string"), F.lit("cache-control"), F.lit("max-age=60")],
    )
    first = record(
        1, "revisit", start + 3_600 * (1 + n % 5),
        F.when(n % 4 == 0, F.concat(F.lit("W/"), digest)).when(n % 7 == 0, F.lit("other")).otherwise(digest),
        F.when(n % 3 > 0, day),
        [F.lit("date"), (start + 3_600).cast("string"), F.lit("server"), F.lit("cache"),
         F.lit("cache-control"), F.lit("max-age=10")],
    )
    second = record(
        2, "revisit", start - 40_000 + 86_400 * (n % 9), none,
        F.when(n % 2 == 0, day).when(n % 3 == 0, F.lit("day x")),
        [F.lit("date"), (start + 86_400).cast("string"), F.lit("expires"), F.lit("0")],
    )
    return pages.select("url", F.inline(F.array(full, first, second)))
