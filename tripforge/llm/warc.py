"""WARC records: canonical URLs and resolution of not-modified revisits.

A record is a row (record_id, uri, at, status, headers, payload): a capture of ``uri`` at second ``at`` with an HTTP
status and a map of lower-case header names. A revisit (status 304) has no payload; it stands for the latest full
response (status 200) captured earlier at the same canonical URL, if their validators agree.

Records from files also have a WARC type and a payload digest. With them only 'response' records of status 200 are full
responses, and a 'revisit' of another status (an identical payload digest, mostly with status 200 and no body) stands for
the latest earlier full response at its canonical URL with its digest; without a digest, validators decide as for a 304.

The as-of join needs no task that holds all captures of a URL: of the responses at one time one is left, revisits count once
for each time, and time is cut into stretches of ``STRETCH`` seconds. The latest response is found within (URL, stretch),
which has no more rows than twice its seconds, and what earlier stretches hold is carried over as one row for each (URL, stretch).

Headers merge as a cache updates a stored response: those of the revisit replace those stored, except the ones that
describe the stored body (``KEPT``).

Defined results: a null uri has no canonical URL and stays unresolved, as does a revisit without an earlier response or
with a null time; responses at the very time of a revisit are not earlier; of responses at one time the largest
record_id counts (null last; of equal ones, one that is the same in every run). Payloads are found by a 64-bit hash of the
response's id, uri, time and payload, so null and repeated record ids do no harm. Repeated rows are resolved each for
itself. Null headers are an empty map. Validators agree if the entity tags are equal apart from a weak mark, or, where
either side has none, if both have equal Last-Modified dates; a revisit that has no validator at all disagrees. Other
columns don't enter; an empty table gives an empty result; a payload is never cut, however long.
"""

from __future__ import annotations

import io
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read_table

STRETCH = 1 << 16
#: Records, and bytes of records, that a reader of files hands on at a time.
RECORDS, RECORD_BYTES = 1000, 32_000_000
#: Header fields of the stored response that a 304 doesn't update.
KEPT = ["content-encoding", "content-length", "content-range", "content-type", "transfer-encoding"]


def canonical_url(url: Column) -> Column:
    """Host (lower case, without user, ``www.`` and default port), path and sorted query; scheme and fragment don't count."""
    part = lambda k: F.regexp_extract(F.trim(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?", k)
    port = F.when(part(2).isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), part(2)))
    query = F.array_join(F.sort_array(F.filter(F.split(part(4), "&"), lambda p: p != "")), "&")
    path = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    return F.when(part(1) != "", F.concat(F.lower(part(1)), port, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], r"^[wW]/", "")


def _agree(mine: Column, stored: Column) -> Column:
    by_tag = F.when(_tag(mine).isNotNull() & _tag(stored).isNotNull(), _tag(mine) == _tag(stored))
    return F.coalesce(by_tag, mine["last-modified"] == stored["last-modified"], F.lit(False))


def _is_full(records: DataFrame) -> Column:
    full = F.col("status").eqNullSafe(200)
    return full & F.coalesce(F.col("type") == "response", F.lit(True)) if "type" in records.columns else full


def _is_revisit(records: DataFrame) -> Column:
    again = F.col("status").eqNullSafe(304)
    return again | F.col("type").eqNullSafe("revisit") if "type" in records.columns else again


def _content_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("record_id").cast("string"), F.lit("")), F.col("record_id").isNull(), "uri", "at", "payload")


def latest_earlier(records: DataFrame, stretch: int = STRETCH, scratch: Scratch | None = None) -> DataFrame:
    """Revisits (record_id, at, url, same, headers) with ``found``, the latest earlier response (at, id, key, headers), or null."""
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers")
    digest = F.col("digest") if "digest" in records.columns else F.lit(None).cast("string")
    same = F.when(~_is_full(records) & ~F.col("status").eqNullSafe(304), digest)
    place = F.concat(F.col("url"), F.coalesce(F.concat(F.lit("#"), F.col("same")), F.lit(""))).alias("place")
    columns = ["record_id", "at", _is_full(records).alias("full"), headers, canonical_url(F.col("uri")).alias("url"), digest.alias("digest"), same.alias("same")]
    with Scratch(records.sparkSession, scratch) as own:
        key = F.when(_is_full(records), _content_key()) if "payload" in records.columns else F.lit(None).cast("long")
        rows = records.where(_is_full(records) | _is_revisit(records)).select(*columns, key.alias("key"))
        if "digest" in records.columns:  # responses are looked up by URL, and by URL and digest
            rows = rows.unionByName(rows.where("full and digest is not null").withColumn("same", F.col("digest")))
        rows = own.keep(rows.drop("digest").select("*", place), "captures")
        usable = rows.where("place is not null and at is not null").withColumn("stretch", F.floor(F.col("at") / stretch))
        response = F.struct(F.col("at"), F.col("record_id").alias("id"), "key", "headers")
        full = usable.where("full").groupBy("place", "stretch", "at").agg(F.max_by(response, F.struct("record_id", "key")).alias("response"))
        asked = usable.where("not full").select("place", "stretch", "at").distinct()
        # a response follows the revisits of its time
        times = asked.withColumn("response", F.lit(None).cast(full.schema["response"].dataType)).unionByName(full)
        here = W.partitionBy("place", "stretch").orderBy("at", F.col("response").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
        near = own.write(times.withColumn("found", F.last("response", ignorenulls=True).over(here)).where("response is null").drop("response"), "within-stretches")
        ends = full.groupBy("place", "stretch").agg(F.max_by("response", "at").alias("end"))
        marks = ends.unionByName(near.select("place", "stretch").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType)))
        marks = marks.groupBy("place", "stretch").agg(F.first("end", ignorenulls=True).alias("end"))
        before = W.partitionBy("place").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
        carried = marks.select("place", "stretch", F.last("end", ignorenulls=True).over(before).alias("carried"))
        joined = near.join(carried, ["place", "stretch"], "left").select("place", "at", F.coalesce("found", "carried").alias("found"))
        found = own.keep(joined.where("found is not null"), "latest-earlier")
    revisits = rows.where("not full").select("record_id", "at", "url", "same", "headers", "place")
    columns = ["record_id", "at", "url", "same", "headers", "found"]
    known = revisits.where("place is not null and at is not null").join(found, ["place", "at"], "left").select(*columns)
    # the rest would all meet in the null key's task
    rest = revisits.where("place is null or at is null").withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    return known.unionByName(rest.select(*columns))


def resolve_revisits(records: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row for each revisit: record_id, at, url, outcome (resolved, validators_differ, no_response), response_id, headers, payload."""
    found = latest_earlier(records, scratch=scratch).withColumn("agree", F.col("found").isNotNull() & (F.col("same").isNotNull() | _agree(F.col("headers"), F.col("found.headers"))))
    update = F.map_filter("headers", lambda k, v: ~k.isin(KEPT))
    stored = F.map_filter("found.headers", lambda k, v: ~F.array_contains(F.map_keys(update), k))
    merged = found.select(
        "record_id", "at", "url",
        F.when(F.col("found").isNull(), "no_response").when(F.col("agree"), "resolved").otherwise("validators_differ").alias("outcome"),
        F.when(F.col("agree"), F.col("found.id")).alias("response_id"), F.when(F.col("agree"), F.col("found.key")).alias("key"),
        F.when(F.col("agree"), F.map_concat(stored, update)).otherwise(F.col("headers")).alias("headers"),
    )
    payloads = records.where(_is_full(records)).select(_content_key().alias("key"), "payload").dropDuplicates(["key"])
    columns = ["record_id", "at", "url", "outcome", "response_id", "headers", "payload"]
    with_payload = merged.where("key is not null").join(payloads, "key", "left").select(*columns)
    rest = merged.where("key is null").withColumn("payload", F.lit(None).cast(payloads.schema["payload"].dataType))
    return with_payload.unionByName(rest.select(*columns))


def _members(data: bytes):
    """The members of a gzipped file one by one, as far as they can be read; a plain file as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at, view = 0, memoryview(data)
    while at < len(view):
        unzip, parts = zlib.decompressobj(31), []
        try:
            while not unzip.eof and at < len(view):
                some = view[at : at + (1 << 16)]
                at += len(some)
                parts.append(unzip.decompress(some))
            at -= len(unzip.unused_data)
        except zlib.error:
            at = len(view)
        yield b"".join(parts)


def parse_warc(data: bytes):
    """(WARC headers, block) of each record of a WARC file, plain or gzipped member by member.

    A record without a usable length, or cut short, ends its member (a plain file is one): what is before it counts.
    """
    for member in _members(data):
        stream = io.BytesIO(member)
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            headers = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            length = headers.get("content-length", "")
            block = stream.read(int(length)) if length.isdecimal() else b""
            if not length.isdecimal() or len(block) < int(length):
                break
            yield headers, block


def _record(head: dict, block: bytes) -> tuple:
    import pandas as pd

    top, _, body = block.partition(b"\r\n\r\n")
    lines = top.decode("latin-1").split("\r\n")
    words = lines[0].split(" ")
    status = int(words[1]) if len(words) > 1 and words[1].isdecimal() and len(words[1]) < 5 else None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    at = pd.to_datetime(head.get("warc-date"), errors="coerce", utc=True)
    return head.get("warc-record-id"), head.get("warc-target-uri"), None if pd.isna(at) else int(at.timestamp()), status, fields, body, head["warc-type"], head.get("warc-payload-digest")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (record_id as text, uri, at, status, headers, payload, type, digest) of WARC files; a task holds one file at a time."""
    names = ["record_id", "uri", "at", "status", "headers", "payload", "type", "digest"]

    def run(batches):
        import pandas as pd

        for batch in batches:
            for data in batch["content"]:
                out, size = [], 0
                for head, block in parse_warc(bytes(data)):
                    if head.get("warc-type") in ("response", "revisit"):
                        out.append(_record(head, block))
                        size += len(block)
                    if len(out) == RECORDS or size > RECORD_BYTES:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
                yield pd.DataFrame(out, columns=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "record_id string, uri string, at long, status int, headers map<string,string>, payload binary, type string, digest string")


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as WARC captures: each is fetched in full at 10 x page_id and asked for again, with validators, five seconds on,
    or 1,000 seconds before or after that; so other pages' responses at its canonical URL come between, and some have none yet.

    Every third page has changed its entity tag by then, every fifth sends only a date, and the second request spells
    the URL differently.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(body), F.lit('"'))
    pid = F.col("page_id")
    first = pages.select(
        (pid * 2).alias("record_id"), F.col("url").alias("uri"), (pid * 10).alias("at"), F.lit(200).alias("status"),
        F.create_map(F.lit("etag"), tag, F.lit("last-modified"), F.concat(F.lit("day "), (pid % 7).cast("string")), F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"), body.alias("payload"),
    )
    tag_then = F.when(pid % 3 == 0, F.lit('"changed"')).when(pid % 5 != 0, F.concat(F.lit("W/"), tag))
    sent = F.create_map(F.lit("etag"), tag_then, F.lit("last-modified"), F.concat(F.lit("day "), (pid % 7).cast("string")), F.lit("content-type"), F.lit("none"), F.lit("cache-control"), F.lit("max-age=600"))
    again = pages.select((pid * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", r"^https?://(www\.)?", "HTTPS://WWW."), F.lit("#again")).alias("uri"), (pid * 10 + 5 + 1000 * (pid % 4 % 3 - 1)).alias("at"), F.lit(304).alias("status"), F.map_filter(sent, lambda k, v: v.isNotNull()).alias("headers"), F.lit(None).cast("string").alias("payload"))
    return first.unionByName(again)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's second request, resolved."""
    done = resolve_revisits(captures_of(read_table(spark, sf_dir, "pages")))
    fields = F.array_join(F.transform(F.sort_array(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    return done.select(((F.col("record_id") - 1) / 2).cast("long").alias("page_id"), "url", "outcome", (F.col("response_id") / 2).cast("long").alias("response_page_id"), fields.alias("headers"), F.md5("payload").alias("payload_md5"))


_CANON = r"'^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?'"
SQL = f"""
with p as (select page_id, url, md5(coalesce(html, '')) as sum, trim(url) as u from pages),
q as (select *, lower(regexp_extract(u, {_CANON}, 1)) as host, regexp_extract(u, {_CANON}, 2) as port, regexp_extract(u, {_CANON}, 3) as path, regexp_extract(u, {_CANON}, 4) as query from p),
c as (select page_id, sum, case when host <> '' then host || case when port in ('', '80', '443') then '' else ':' || port end || case when path = '' then '/' else path end
    || case when array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '')), '&') = '' then '' else '?' || array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '')), '&') end end as url from q),
found as (select a.page_id, arg_max(b.page_id, b.page_id) as hit from c a join c b on a.url = b.url and b.page_id * 10 < a.page_id * 10 + 5 + 1000 * (a.page_id % 4 % 3 - 1) group by a.page_id),
j as (select c.page_id, c.url, f.hit, c.sum as sum, h.sum as stored, case when c.page_id % 3 = 0 then 'changed' when c.page_id % 5 <> 0 then c.sum end as tag
  from c left join found f on c.page_id = f.page_id left join c h on h.page_id = f.hit),
k as (select *, case when hit is null then 'no_response' when tag is not null then case when tag = stored then 'resolved' else 'validators_differ' end
  when page_id % 7 = hit % 7 then 'resolved' else 'validators_differ' end as outcome from j)
select page_id, url, outcome, case when outcome = 'resolved' then hit end as response_page_id,
  'cache-control: max-age=600; content-type: ' || case when outcome = 'resolved' then 'text/html' else 'none' end
  || case when tag = 'changed' then '; etag: "changed"' when tag is not null then '; etag: W/"' || tag || '"' when outcome = 'resolved' then '; etag: "' || stored || '"' else '' end
  || '; last-modified: day ' || (page_id % 7) as headers,
  case when outcome = 'resolved' then stored end as payload_md5
from k
"""
