"""The registered queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsetrace.llm import (byte_bpe, html_text, importance, line_crf, multiprobe, prefix_trie, quality_rules, secret_scan,
                            simhash, source_mix, suffix_dedup, topk, warc_revisits)
from pulsetrace.session import materialise


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents"))

    def count(kind):
        return F.size(F.filter("found", lambda s: s.kind == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    base = F.filter("found", lambda s: s.kind != "markov")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    both = byte_bpe.decode(byte_bpe.encode(docs).drop("text", "token_ends"))
    return both.select("doc_id", (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"),
                       F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix.counts(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op5_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.classes(table(spark, folder, "documents"))


def op6_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    return line_crf.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def captures(pages: DataFrame) -> DataFrame:
    """Four archive records per page: two full responses with changed validators, an error, and a revisit.

    The revisit comes after all of them, between the responses (id % 11 = 1) or before (id % 11 = 0), and names the
    latest response before it by ETag, by date, wrongly or not at all.
    """
    day = F.lit("2024-01-01 00:00:00").cast("timestamp")
    nth = F.col("page_id")
    start = nth % 1000

    def at(minutes):
        return F.timestamp_add("MINUTE", minutes.cast("int"), day)

    def changed(minutes):
        return F.date_format(at(minutes), "yyyy-MM-dd HH:mm")

    def tag(body):
        return F.concat(F.lit('"'), F.md5(body), F.lit('"'))

    def response(mark, minutes, status, body):
        return pages.select(
            F.concat(F.lit(mark), nth).alias("record_id"), F.col("url").alias("uri"), at(minutes).alias("date"),
            F.lit("response").alias("kind"), F.lit(status).alias("status"), F.create_map(
                F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.char_length(body).cast("string"),
                F.lit("ETag"), tag(body), F.lit("Last-Modified"), changed(minutes), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
            body.alias("html"))

    first, second = F.col("html"), F.concat("html", F.lit(" v2"))
    early = nth % 11 == 1
    own = F.when(nth % 5 == 0, F.create_map(F.lit("ETag"), F.lit('"stale"'))).when(
        nth % 7 == 0, F.create_map(F.lit("last-modified"), F.when(early, changed(start)).otherwise(changed(start + 200)))).when(
        nth % 13 == 0, F.create_map().cast("map<string,string>")).otherwise(
            F.create_map(F.lit("etag"), F.concat(F.lit("W/"), F.when(early, tag(first)).otherwise(tag(second)))))
    again = pages.select(
        F.concat(F.lit("v"), nth).alias("record_id"), F.concat("url", F.lit("#again")).alias("uri"),
        at(F.when(nth % 11 == 0, start - 500).when(early, start + 100).otherwise(start + 700)).alias("date"), F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"), F.map_concat(own, F.create_map(
            F.lit("Cache-Control"), F.concat(F.lit("max-age="), nth % 100), F.lit("Content-Length"), F.lit("0"),
            F.lit("X-Cache"), F.lit("HIT"))).alias("headers"), F.lit(None).cast("string").alias("html"))
    return (response("r", start, 200, first).union(response("s", start + 200, 200, second))
            .union(response("t", start + 300, 404, F.lit("gone"))).union(again))


def op7_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    records = captures(table(spark, folder, "pages"))
    resolved = materialise(warc_revisits.resolve(records))
    bodies = warc_revisits.with_payload(records, resolved).select(F.col("record_id").alias("id"), F.char_length("html").cast("long").alias("body_chars"))
    number = lambda c: F.substr(F.col(c), F.lit(2)).cast("long")
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e.key, e.value))
    return resolved.join(bodies, F.col("record_id") == F.col("id"), "left").select(
        number("record_id").alias("page_id"), "url", number("source_id").alias("source_page_id"),
        F.substring("source_id", 1, 1).alias("source_version"), "verdict",
        F.array_join(lines, "; ").alias("headers"), "body_chars")


_REVISITS_SQL = r"""
    WITH p AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
    q AS (SELECT *, string_split(bare, '?')[1] AS address,
        CASE WHEN instr(bare, '?') > 0 THEN substr(bare, instr(bare, '?') + 1) ELSE '' END AS query FROM p),
    c AS (SELECT *, regexp_replace(lower(string_split(address, '/')[1]), '^www\.|:(80|443)$', '', 'g')
        || regexp_replace(CASE WHEN instr(address, '/') > 0 THEN substr(address, instr(address, '/')) ELSE '' END, '/+$', '') AS place,
        list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid)(=|$)'))) AS params FROM q),
    u AS (SELECT page_id, html, place || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url FROM c),
    r AS (SELECT 'r' || page_id AS id, page_id, url, (page_id % 1000) AS t, true AS is_full FROM u
        UNION ALL SELECT 's' || page_id, page_id, url, page_id % 1000 + 200, true FROM u
        UNION ALL SELECT 'v' || page_id, page_id, url, CASE page_id % 11 WHEN 0 THEN page_id % 1000 - 500
            WHEN 1 THEN page_id % 1000 + 100 ELSE page_id % 1000 + 700 END, false FROM u),
    o AS (SELECT 'r' || page_id AS id, page_id, html, page_id % 1000 AS t FROM pages
        UNION ALL SELECT 's' || page_id, page_id, html || ' v2', page_id % 1000 + 200 FROM pages),
    w AS (SELECT *, last_value(CASE WHEN is_full THEN id END IGNORE NULLS) OVER (
        PARTITION BY url ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM r),
    m AS (SELECT w.page_id, w.url, src.page_id AS hit, w.hit[1] AS version, src.html AS stored,
        CASE WHEN w.page_id % 5 = 0 THEN '"stale"' WHEN w.page_id % 7 = 0 OR w.page_id % 13 = 0 THEN NULL ELSE 'W/"' || md5(me.html) || '"' END AS etag,
        CASE WHEN w.page_id % 5 <> 0 AND w.page_id % 7 = 0 THEN strftime(TIMESTAMP '2024-01-01' + INTERVAL (me.t) MINUTE, '%Y-%m-%d %H:%M') END AS changed,
        '"' || md5(src.html) || '"' AS old_etag, strftime(TIMESTAMP '2024-01-01' + INTERVAL (src.t) MINUTE, '%Y-%m-%d %H:%M') AS old_changed
        FROM w JOIN o me ON me.id = (CASE WHEN w.page_id % 11 = 1 THEN 'r' ELSE 's' END) || w.page_id LEFT JOIN o src ON src.id = w.hit WHERE NOT w.is_full),
    v AS (SELECT *, CASE WHEN hit IS NULL THEN 'no_response' WHEN etag IS NULL AND changed IS NULL THEN 'unverified'
        WHEN coalesce(regexp_replace(etag, '^W/', '') = old_etag, changed = old_changed) THEN 'match' ELSE 'mismatch' END AS verdict FROM m)
    SELECT page_id, url, CASE WHEN verdict IN ('match', 'unverified') THEN hit END AS source_page_id,
        CASE WHEN verdict IN ('match', 'unverified') THEN version END AS source_version, verdict,
        'cache-control: max-age=' || (page_id % 100) || '; content-length: '
        || CASE WHEN verdict IN ('match', 'unverified') THEN length(stored)::VARCHAR || '; content-type: text/html' ELSE '0' END
        || coalesce('; etag: ' || coalesce(etag, CASE WHEN verdict IN ('match', 'unverified') THEN old_etag END), '')
        || coalesce('; last-modified: ' || coalesce(changed, CASE WHEN verdict IN ('match', 'unverified') THEN old_changed END), '')
        || '; x-cache: HIT' AS headers,
        CASE WHEN verdict IN ('match', 'unverified') THEN length(stored) END AS body_chars FROM v"""


def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = topk.nearest(table(spark, folder, "embeddings"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


_TOPK_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = suffix_dedup.passages(docs)
    doc, mark = suffix_dedup.identity()
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x.hi - x.lo)
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.lo, x.hi)), ",")
    rows = docs.select("doc_id", doc.alias("doc"), mark.alias("mark"))
    return rows.join(found, ["doc", "mark"]).select(
        "doc_id", "n_words", words("shared").alias("n_shared"), words("later").alias("n_later"),
        spans("shared").alias("shared_spans"), spans("later").alias("later_spans"))


def _quality_sql() -> str:
    rules = quality_rules.Rules()
    share = {
        "symbol_share": ("n_symbols", "word_chars", 10000), "dup_line_share": ("n_dup_lines", "n_lines", 10000),
        "repeat_share": ("n_repeat_words", "n_words", 10000), "capital_share": ("n_capitals", "word_chars", 10000),
        "word_length": ("word_chars", "n_words", 100)}
    cells = " UNION ALL ".join(
        f"SELECT lang, source, '{name}' AS metric, ({scale} * {part}) // {whole} AS v FROM counts WHERE {whole} > 0"
        for name, (part, whole, scale) in share.items())
    spread = " ".join(f"WHEN '{name}' THEN {least}" for name, least in rules.least_spread)
    lists = "'" + "', '".join(sorted(quality_rules.TWO_SIDED)) + "'"
    few = rules.min_docs

    def picked(c):
        return (f"CASE WHEN a.docs >= {few} THEN a.{c} WHEN b.docs >= {few} THEN b.{c} ELSE c.{c} END")

    bad = " OR ".join(
        f"(l.metric = '{name}' AND c.{whole} > 0 AND ({scale} * c.{part}) // c.{whole} NOT BETWEEN l.least AND l.most)"
        for name, (part, whole, scale) in share.items())
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    i AS (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS p FROM w),
    g AS (SELECT rid, p, list_slice(ws, p, p + 4) AS gram FROM i),
    twice AS (SELECT rid, gram FROM g GROUP BY rid, gram HAVING count(*) > 1),
    spots AS (SELECT rid, unnest(range(p, p + 5)) AS p FROM g JOIN twice USING (rid, gram)),
    rep AS (SELECT rid, count(DISTINCT p) AS n FROM spots GROUP BY rid),
    counts AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
        (length(t) - length(translate(t, '{quality_rules.CAPITALS}', '')))::BIGINT AS n_capitals, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
        FROM w LEFT JOIN rep USING (rid)),
    cells AS ({cells}),
    bins AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS b, count(*) AS n FROM cells GROUP BY ALL),
    levels AS (SELECT 0 AS level, lang, source, metric, b, n FROM bins
        UNION ALL SELECT 1, lang, NULL, metric, b, sum(n) FROM bins GROUP BY lang, metric, b
        UNION ALL SELECT 2, NULL, NULL, metric, b, sum(n) FROM bins GROUP BY metric, b),
    ranked AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY b) AS upto,
        sum(n) OVER (PARTITION BY level, lang, source, metric) AS docs FROM levels),
    q AS (SELECT level, lang, source, metric, any_value(docs) AS docs, min(b) FILTER (4 * upto >= docs) AS q1,
        min(b) FILTER (4 * upto >= 2 * docs) AS q2, min(b) FILTER (4 * upto >= 3 * docs) AS q3,
        CASE metric {spread} END AS floor FROM ranked GROUP BY level, lang, source, metric),
    marks AS (SELECT level, lang, source, metric, docs, q3 + {rules.reach} * greatest(q3 - q2, floor) AS most,
        CASE WHEN metric IN ({lists}) THEN q1 - {rules.reach} * greatest(q2 - q1, floor) ELSE 0 END AS least FROM q),
    lim AS (SELECT a.lang, a.source, a.metric, {picked("least")} AS least, {picked("most")} AS most FROM marks a
        JOIN marks b ON a.metric = b.metric AND a.lang IS NOT DISTINCT FROM b.lang AND b.level = 1
        JOIN marks c ON a.metric = c.metric AND c.level = 2 WHERE a.level = 0),
    fails AS (SELECT DISTINCT c.rid FROM counts c JOIN lim l ON c.lang IS NOT DISTINCT FROM l.lang
        AND c.source IS NOT DISTINCT FROM l.source WHERE {bad}),
    base AS (SELECT *, (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) AS base_failed FROM counts)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        (NOT base_failed AND fails.rid IS NULL) AS kept FROM base LEFT JOIN fails ON base.rid = fails.rid"""


def op11_multiprobe_ann(spark: SparkSession, folder: str) -> DataFrame:
    found = multiprobe.nearest(table(spark, folder, "embeddings"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op12_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def crc32(text: str) -> str:
    """DuckDB expression: unsigned CRC-32 of a string's UTF-8 bytes, bit by bit."""
    steps = f"flatten(list_transform(range(octet_length(encode({text}))), lambda i: [('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda c, x: "
            "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)")


_IMPORTANCE_SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
    one AS (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY ALL),
    cells AS (SELECT w, {crc32("w")} % 10000 AS cell FROM (SELECT w FROM one UNION SELECT w FROM b)),
    s AS (SELECT cell, sum(n)::BIGINT AS s FROM one JOIN cells USING (w) GROUP BY cell),
    t AS (SELECT cell, count(*) AS t FROM b JOIN cells USING (w) GROUP BY cell),
    g AS (SELECT cell, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
        / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (cell)),
    sums AS (SELECT rid, sum(n * gain)::BIGINT AS total FROM one JOIN cells USING (w) JOIN g USING (cell) GROUP BY rid),
    w AS (SELECT d.rid, doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) = 0 THEN 0
        ELSE (total - ((total % len(ws)) + len(ws)) % len(ws)) // len(ws) END::BIGINT AS weight FROM d LEFT JOIN sums USING (rid)),
    x AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
        / 4294967296::DOUBLE)))::BIGINT AS score FROM w),
    r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank FROM x WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM r) THEN rank END AS rank
    FROM x LEFT JOIN r USING (rid)"""


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, folder, "conversations"))


_TRIE_SQL = f"""
    WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    shared AS (SELECT conv_id, turns, ({crc32("conv_id::VARCHAR")} % 9)::BIGINT AS h FROM own),
    built AS (SELECT a.conv_id, list_concat(coalesce(list_slice(b.turns, 1, a.h), []), list_slice(a.turns, a.h + 1, len(a.turns))) AS turns
        FROM shared a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
    p AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM built),
    q AS (SELECT conv_id, n, depth, md5(list_slice(turns, 1, depth)::VARCHAR) AS mark, CASE WHEN depth > 0 THEN octet_length(encode(turns[depth].text)) ELSE 0 END AS size FROM p),
    node AS (SELECT depth, mark, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM q GROUP BY depth, mark),
    path AS (SELECT DISTINCT a.depth, a.mark, b.depth AS up_depth, b.mark AS up_mark FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.depth <= a.depth),
    kids AS (SELECT up_depth AS depth, up_mark AS mark, count(*) AS n_children FROM path WHERE up_depth = depth - 1 GROUP BY ALL),
    whole AS (SELECT up_depth AS depth, up_mark AS mark, count(*) FILTER (kids.n_children IS NULL) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
        FROM path JOIN node USING (depth, mark) LEFT JOIN kids USING (depth, mark) GROUP BY ALL),
    above AS (SELECT path.depth, path.mark, node.conv_id AS parent_conv_id FROM path JOIN node ON node.depth = up_depth AND node.mark = up_mark WHERE up_depth = path.depth - 1)
    SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, ends_sha256
    FROM node JOIN whole USING (depth, mark) LEFT JOIN kids USING (depth, mark) LEFT JOIN above USING (depth, mark)"""


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_quality_rules, op3_byte_bpe, op4_source_mix, op5_simhash_dedup, op6_line_crf,
    op7_warc_revisits, op8_html_text, op9_exact_topk,
    op10_suffix_dedup, op11_multiprobe_ann, op12_importance, op13_prefix_trie)}
ORACLES = {"op2_quality_rules": _quality_sql(), "op7_warc_revisits": _REVISITS_SQL, "op9_exact_topk": _TOPK_SQL,
           "op12_importance": _IMPORTANCE_SQL, "op13_prefix_trie": _TRIE_SQL}
