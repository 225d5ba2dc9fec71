"""Not-modified revisits of a web archive: each gets the latest earlier full response of its canonical URL.

The as-of join works on slim rows (no bodies). Records are range-partitioned and sorted by (canonical URL, time),
so one much-crawled URL is split over as many partitions as it fills. Each partition carries its last response
forward in one pass; what a partition's first rows need from before is one row per partition, joined back. The
match is then checked by validators (ETag, compared weakly, else Last-Modified) and the stored headers are updated
by those of the revisit that may be: connection-level and content-describing ones stay as stored.

A record: record_id, uri, date (timestamp), kind ("response" or "revisit"), status, headers (map of string to
string) and any further columns, such as the body.

Defined cases. Null uri or date: no place in the order; a revisit then has verdict "no_response". Null headers:
none. Names of headers are compared in lower case; of two that differ in case only, the later in order wins. A
response at the same time as a revisit counts as earlier only with a smaller record_id. Full responses have kind
"response" and status 200 (null status: 200). Repeated rows are each resolved. Empty table: empty result. Other
columns are ignored by ``resolve`` and kept by ``with_payload``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsetrace.llm.common import OWN, named, parallelism
from pulsetrace.session import materialise

#: Headers that a not-modified response never replaces.
KEPT_AS_STORED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that never change a page.
TRACKING = "utm_[a-z]+|fbclid|gclid"


def canonical(uri: Column) -> Column:
    """Host and path in one spelling: no scheme, "www.", default port, fragment, tracking parameters or closing
    slash; host in lower case, parameters in order."""
    bare = F.regexp_replace(F.trim(uri), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    address, query = F.substring_index(bare, "?", 1), F.when(F.instr(bare, "?") > 0, F.substr(bare, F.instr(bare, "?") + 1))
    host = F.regexp_replace(F.lower(F.substring_index(address, "/", 1)), "^www\\.|:(80|443)$", "")
    path = F.when(F.instr(address, "/") > 0, F.substr(address, F.instr(address, "/"))).otherwise("")
    kept = F.array_sort(F.filter(F.split(F.coalesce(query, F.lit("")), "&"),
                                 lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, F.regexp_replace(path, "/+$", ""),
                    F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lowered(headers: Column) -> Column:
    """Headers by lower-case name."""
    pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    return F.aggregate(F.array_sort(pairs), F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(
        F.map_filter(m, lambda k, _: k != F.lower(e.key)), F.create_map(F.lower(e.key), e.value)))


def last_responses(rows: DataFrame) -> DataFrame:
    """Adds ``hit`` to rows of (url, date, record_id, full): id of the latest earlier full response."""
    order = ["url", "date", "record_id"]
    parts = rows.repartitionByRange(parallelism(rows), *order).sortWithinPartitions(*order)
    parts = parts.withColumn("part", F.spark_partition_id())

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        url = last = None
        for batch in batches:
            urls, ids, full = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("url", "record_id", "full"))
            hits = []
            for u, i, f in zip(urls, ids, full):
                if u != url:
                    url, last = u, None
                hits.append(last)
                if f:
                    last = i
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.string())],
                                             names=[*batch.schema.names, "hit"])

    schema = parts.schema.simpleString()[len("struct<"):-1]
    swept = materialise(parts.mapInArrow(carry, f"{schema},hit:string"))
    # One row per partition: its last URL and that URL's last response, if any.
    place = F.struct("date", "record_id")
    ends = swept.groupBy("part").agg(F.max("url").alias("end_url"))
    tails = swept.join(ends, "part").where("url = end_url").groupBy("part", "end_url").agg(
        F.max(F.when(F.col("full"), place)).alias("tail"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("tail").isNotNull(), F.struct("end_url", F.col("tail.record_id").alias("id")))
    carried = ends.select("part").join(tails, "part", "left").select(
        F.col("part").alias("at"), F.last(known, True).over(before).alias("earlier"))
    return swept.join(carried, F.col("part") == F.col("at"), "left").withColumn("hit", F.coalesce(
        "hit", F.when(F.col("earlier.end_url") == F.col("url"), F.col("earlier.id")))).drop("part", "at", "earlier")


def resolve(records: DataFrame) -> DataFrame:
    """record_id, url, source_id, verdict and merged headers of every revisit.

    verdict: "match" (a validator agrees), "unverified" (nothing to compare), "mismatch" or "no_response"; the last
    two have no source_id and keep the revisit's own headers.
    """
    slim = materialise(records.select(
        named("record_id").cast("string").alias("record_id"), canonical(named("uri")).alias("url"),
        named("date").cast("timestamp").alias("date"), named("kind").alias("kind"),
        ((named("kind") == "response") & (F.coalesce(named("status").cast("int"), F.lit(200)) == 200)).alias("full"),
        lowered(named("headers")).alias("headers")))
    placed = slim.where("url IS NOT NULL AND date IS NOT NULL AND (kind = 'revisit' OR full)")
    hits = last_responses(placed.select("url", "date", "record_id", F.coalesce("full", F.lit(False)).alias("full")))
    hits = hits.where(F.col("hit").isNotNull() & ~F.col("full")).select(
        F.col("url").alias("u"), F.col("date").alias("d"), F.col("record_id").alias("r"), "hit").dropDuplicates(["r", "d", "u"])
    asked = slim.where("kind = 'revisit'").join(hits, F.expr("record_id = r AND date = d AND url = u"), "left")
    stored = slim.where("full").select(F.col("record_id").alias("id"), F.col("headers").alias("old")).dropDuplicates(["id"])
    both = asked.join(stored, F.col("hit") == F.col("id"), "left")
    tag = lambda c: F.regexp_replace(F.element_at(c, "etag"), "^W/", "")
    date = lambda c: F.element_at(c, "last-modified")
    checked = F.coalesce(tag("headers") == tag("old"), date("headers") == date("old"))
    verdict = F.when(F.col("id").isNull(), "no_response").when(checked.isNull(), "unverified").when(checked, "match").otherwise("mismatch")
    used = F.col("verdict").isin("match", "unverified")
    permitted = F.map_filter("headers", lambda k, _: ~k.isin(*KEPT_AS_STORED))
    merged = F.map_concat(F.map_filter("old", lambda k, _: ~F.array_contains(F.map_keys(permitted), k)), permitted)
    return both.withColumn("verdict", verdict).select(
        "record_id", "url", F.when(used, F.col("id")).alias("source_id"), "verdict",
        F.when(used, merged).otherwise(F.col("headers")).alias("headers"))


def with_payload(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """The resolved revisits with the other columns of their source record (the body among them)."""
    rest = [named(c) for c in records.columns if c not in ("record_id", "headers", "uri", "date", "kind", "url", "source_id", "verdict")]
    source = records.select(named("record_id").cast("string").alias(OWN + "id"), *rest).dropDuplicates([OWN + "id"])
    return resolved.where("source_id IS NOT NULL").join(source, F.col("source_id") == F.col(OWN + "id")).drop(OWN + "id")
