"""WARC: resolution of not-modified revisits against the latest earlier full response of the same canonical URL.

An as-of join over points in time. Records are first reduced to one point per (URL, time) with map-side combining: the
largest response id there, and whether a revisit asks there; so any number of captures at one time is one row. Points
are dealt by range of (URL, time) into blocks of about equal count, however often a URL was captured; inside a
(URL, block) a window finds the latest response before each point, and a window over one row per block carries the
latest response of earlier blocks forward. Headers and validators are fetched afterwards by record id, a plain join
that the planner can split where one response answers very many revisits.

A revisit is resolved if its validators agree with the response's: the entity tag where both have one (weak
comparison), else the last-modified date where both have one. Headers that a 304 may update replace the stored ones;
the others stay as stored.

Records: record_id long, url string, ts long (seconds), kind string (``response`` or ``revisit``), headers map.

Defined cases: header names are compared in lower case, of equal names the first counts; a null URL or time resolves
nothing (``no_earlier``); equal times are not earlier; among responses of one time the largest record_id counts;
repeated rows of a response are one; repeated revisits are each answered; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import checkpoint

DAY = 86_400
#: Headers that a not-modified answer may update.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that don't name content.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessionid|sid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Scheme, user, ``www.``, default port, fragment, tracking parameters, outer blanks and last slashes go, however
    often they are repeated; host in lower case; parameters sorted. A canonical URL is its own canonical form."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^(?:\s|[A-Za-z][A-Za-z0-9+.-]*://|[^/?@]*@)+|\s+$", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, r"(?:\s|:(?:80|443)?)+$", ""), r"^(?:\s|www[0-9]*\.)+", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"[/\s]+$", "")
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    strip = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    kept = F.array_sort(F.filter(F.transform(F.split(query, "&"), strip), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    """A header map with names in lower case; of equal names the first stays; null becomes empty."""
    headers = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    names = F.array_distinct(F.transform(F.map_keys(headers), lambda k: F.lower(k)))
    first = lambda n: F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == n), F.lit(0))["value"]
    return F.map_from_arrays(names, F.transform(names, first))


def latest_earlier(records: DataFrame, blocks: int | None = None) -> DataFrame:
    """Distinct (at_key, at_ts) of the revisits in records (record_id, key, ts, kind) → source_id: the latest response
    of that key that is strictly earlier (null without any). blocks: how many ranges points are dealt into."""
    blocks = blocks or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = F.col("kind") == "response"
    r = records.filter("key is not null and ts is not null").groupBy("key", "ts")
    r = r.agg(F.max(F.when(full, F.col("record_id"))).alias("id"), F.max(F.col("kind") == "revisit").alias("asked"))
    r = r.withColumn("me", F.when(F.col("id").isNotNull(), F.struct("ts", "id"))).repartitionByRange(blocks, "key", "ts")
    r = checkpoint(r.withColumn("block", F.spark_partition_id()))
    ahead = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = r.groupBy("key", "block").agg(F.max("me").alias("last")).select("key", "block", F.max("last").over(ahead).alias("carried"))
    inside = Window.partitionBy("key", "block").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    seen = r.withColumn("near", F.max("me").over(inside)).filter("asked")
    joined = seen.join(checkpoint(carried.filter("carried is not null")), ["key", "block"], "left")
    return joined.select(F.col("key").alias("at_key"), F.col("ts").alias("at_ts"), F.coalesce(F.col("near.id"), F.col("carried.id")).alias("source_id"))


def resolve(records: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row per revisit: record_id, canonical_url, source_id, status, headers (merged where resolved, else own).

    status: resolved, no_earlier (no full response before it), mismatch (validators differ), unverified (none in
    common).
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("key"), "ts", "kind", lower_names(F.col("headers")).alias("headers"))
    asof = checkpoint(latest_earlier(rows, blocks))
    asked = rows.filter("kind = 'revisit'").join(asof, (F.col("key") == F.col("at_key")) & (F.col("ts") == F.col("at_ts")), "left")
    asked = asked.select("record_id", "key", "headers", "source_id")
    stored = rows.filter("kind = 'response'").select(F.col("record_id").alias("sid"), F.array_sort(F.map_entries("headers")).alias("stored"))
    stored = checkpoint(stored.groupBy("sid").agg(F.min("stored").alias("stored")))
    d = checkpoint(asked).join(stored, F.col("source_id") == F.col("sid"), "left").withColumn("stored", F.map_from_entries("stored"))

    weak = lambda tag: F.regexp_replace(F.trim(tag), "^W/", "")
    tag, own_tag = F.col("stored")["etag"], F.col("headers")["etag"]
    day, own_day = F.col("stored")["last-modified"], F.col("headers")["last-modified"]
    agrees = F.when(tag.isNotNull() & own_tag.isNotNull(), weak(tag) == weak(own_tag)).when(day.isNotNull() & own_day.isNotNull(), day == own_day)
    status = F.when(F.col("source_id").isNull(), "no_earlier").when(agrees, "resolved").when(~agrees, "mismatch").otherwise("unverified")
    permitted = F.array(*map(F.lit, PERMITTED))
    news = F.map_filter("headers", lambda k, v: F.array_contains(permitted, k) & v.isNotNull())
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.array_contains(permitted, k) | F.col("headers")[k].isNull()), news)
    d = d.withColumn("status", status)
    return d.select("record_id", F.col("key").alias("canonical_url"), "source_id", "status", F.when(F.col("status") == "resolved", merged).otherwise(F.col("headers")).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """WARC records of the table of pages: of each page a full response, and two later revisits by other spellings.

    The revisits' validators follow page_id: agreeing tag, weak tag, date only, a tag that differs, or none.
    """
    t = F.col("page_id") * 600
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), F.floor(t / DAY).cast("string"))
    way = F.pmod(F.col("page_id"), F.lit(5))

    def headers(**values: Column) -> Column:
        names = [n.replace("_", "-") for n in values]
        entries = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in zip(names, values.values(), strict=True)])
        return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))

    def record(n: int, kind: str, url: Column, ts: Column, h: Column) -> Column:
        return F.struct((F.col("page_id") * 3 + n).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit(kind).alias("kind"), h.alias("headers"))

    own_tag = F.when(way == 0, tag).when(way == 1, F.concat(F.lit("W/"), tag)).when(way == 3, F.lit('"other"'))
    own_day = F.when(way == 2, day)
    full = headers(Content_Type=F.lit("text/html"), Content_Length=F.length("html").cast("string"), ETag=tag, Last_Modified=day, Date=t.cast("string"), Cache_Control=F.lit("max-age=60"))
    again = lambda ts: headers(ETag=own_tag, Last_Modified=own_day, Date=ts.cast("string"), Content_Length=F.lit("0"), Expires=(ts + 60).cast("string"))
    soon, late = t + 300, t + 3 * DAY
    other = F.concat(F.regexp_replace("url", "^https?://", "HTTPS://www."), F.lit("#again"))
    return pages.select(F.inline(F.array(record(0, "response", F.col("url"), t, full), record(1, "revisit", F.col("url"), soon, again(soon)), record(2, "revisit", other, late, again(late)))))


def op1_revisits(spark, sf_dir: str) -> DataFrame:
    found = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "canonical_url", "source_id", "status", F.array_join(lines, "\n").alias("headers"))


ORACLE = r"""
with p as (select page_id, url, html, page_id * 600 as t, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' as tag,
  'day ' || cast(page_id * 600 // 86400 as varchar) as dy, page_id % 5 as way from pages),
u as (select page_id * 3 as record_id, url, t as ts, 0 as nr, html, tag, dy, way from p
  union all select page_id * 3 + 1, url, t + 300, 1, html, tag, dy, way from p
  union all select page_id * 3 + 2, regexp_replace(url, '^https?://', 'HTTPS://www.') || '#again', t + 259200, 2, html, tag, dy, way from p),
c0 as (select *, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '^(?:\s|[A-Za-z][A-Za-z0-9+.-]*://|[^/?@]*@)+|\s+$', '', 'g') as bare from u),
c as (select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '(?:\s|:(?:80|443)?)+$', ''), '^(?:\s|www[0-9]*\.)+', '') as host,
  regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '[/\s]+$', '') as path,
  list_sort(list_filter(list_transform(string_split(regexp_extract(bare, '(?s)\?(.*)$', 1), '&'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' and
    not regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessionid|sid)(=|$)'))) as q from c0),
k as (select *, host || path || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as key from c),
full_r as (select record_id, key, ts, tag, dy, length(html) as n from k where nr = 0),
rev as (select record_id, key, ts, way, tag, dy from k where nr > 0),
r as (select *, case way when 0 then tag when 1 then 'W/' || tag when 3 then '"other"' end as own_tag, case way when 2 then dy end as own_day from rev),
j as (select r.record_id, r.key, r.ts, own_tag, own_day, f.record_id as source_id, f.tag as stag, f.dy as sdy, f.n, f.ts as fts
  from r left join full_r f on f.key = r.key and f.ts < r.ts
  qualify row_number() over (partition by r.record_id order by f.ts desc nulls last, f.record_id desc) = 1),
s as (select *, case when source_id is null then 'no_earlier'
  when own_tag is not null then case when regexp_replace(own_tag, '^W/', '') = stag then 'resolved' else 'mismatch' end
  when own_day is not null then case when own_day = sdy then 'resolved' else 'mismatch' end else 'unverified' end as status from j)
select record_id, key as canonical_url, source_id, status,
  case when status = 'resolved' then concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || n, 'content-type: text/html', 'date: ' || ts,
    'etag: ' || coalesce(own_tag, stag), 'expires: ' || (ts + 60), 'last-modified: ' || coalesce(own_day, sdy))
  else concat_ws(chr(10), 'content-length: 0', 'date: ' || ts, 'etag: ' || own_tag, 'expires: ' || (ts + 60), 'last-modified: ' || own_day) end as headers
from s
"""

QUERIES = {"op1_revisits": op1_revisits}
ORACLE_SQL = {"op1_revisits": ORACLE}
