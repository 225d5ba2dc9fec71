"""Facts from other logs: TLS handshakes, DNS answers, domain registrations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetrace.functions.text import entropy
from pulsetrace.operators.asof import carried
from pulsetrace.operators.joins import counted_lookup

TLS_FEATURES = ("ja3_known_client", "cipher_suite_count", "tls_version", "extension_count",
                "cert_validity_days", "cert_is_self_signed", "cert_subject_cn_entropy")

DAY_US = 86_400_000_000


def _listed(column: str) -> Column:
    """Number of entries in a comma-separated list; an empty or missing list has none."""
    text = F.coalesce(F.col(column), F.lit(""))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, ",")))


def common_name(column: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"CN=([^,]*)", 1)


def tls_features(flows: DataFrame, tls: DataFrame, allowed_ja3: DataFrame,
                 keep: Sequence[str] = ("uid",)) -> DataFrame:
    """Properties of each flow's handshake, joined on ``uid``; never its identities.

    Both sides have one row per ``uid``, so no key is hot there. Most handshakes may share one client
    fingerprint, so the allow list is matched per distinct fingerprint and dealt out in slices.
    """
    known = allowed_ja3.select("ja3").distinct().withColumn("_known", F.lit(True))
    described = counted_lookup(tls, known, ["ja3"], ["uid"]).select(
        "uid",
        F.coalesce("_known", F.lit(False)).alias("ja3_known_client"),
        _listed("ciphers").alias("cipher_suite_count"), "tls_version",
        _listed("extensions").alias("extension_count"),
        F.floor((F.col("not_after_us") - F.col("not_before_us")) / F.lit(DAY_US)).cast("int")
        .alias("cert_validity_days"),
        (F.col("subject") == F.col("issuer")).alias("cert_is_self_signed"),
        entropy(common_name("subject")).alias("cert_subject_cn_entropy"))
    return flows.select(*keep).join(described, "uid", "left")


def latest_answer(flows: DataFrame, dns: DataFrame, max_gap_us: int | None = None,
                  ranges: int | None = None) -> DataFrame:
    """For each flow the last DNS query of its host that resolved to its destination before it.

    ``dns``: ``ts_us``, ``orig_h``, ``query``, ``answer``. Flows and answers are swept together in time order, so
    neither side is paired row by row and a busy pair is spread over as many ranges as it fills. An answer of the
    flow's own time counts; of several at one time the greatest name.
    """
    keys = ["orig_h", "resp_h"]
    answers = dns.groupBy("orig_h", F.col("answer").alias("resp_h"), "ts_us").agg(
        F.max("query").alias("query"))
    found = F.struct(F.col("ts_us"), F.col("query"))
    lines = answers.select(*keys, "ts_us", F.lit(None).cast("string").alias("uid"),
                           F.lit(0).alias("kind"), found.alias("hit"))
    asks = flows.select(*keys, "ts_us", "uid", F.lit(1).alias("kind"),
                        F.lit(None).cast(lines.schema["hit"].dataType).alias("hit"))
    swept = carried(lines.unionByName(asks), keys, ["ts_us", "kind", "uid"], "hit", "seen",
                    ranges=ranges).where("kind = 1")
    gap = F.col("ts_us") - F.col("seen.ts_us")
    usable = gap <= max_gap_us if max_gap_us is not None else F.lit(True)
    return swept.select(
        "uid", *keys, "ts_us",
        F.when(usable, F.col("seen.query")).alias("query"),
        F.when(usable, gap).alias("answer_age_us"))


def domain_lexical(names: DataFrame, column: str = "query") -> DataFrame:
    """Character statistics of a domain's registrable part and a score that rises with randomness."""
    name = F.lower(F.regexp_replace(F.col(column), r"\.[^.]*$", ""))
    size = F.length(name)
    digits = size - F.length(F.regexp_replace(name, r"[0-9]", ""))
    vowels = size - F.length(F.regexp_replace(name, r"[aeiou]", ""))
    out = names.withColumns({
        "name_length": size,
        "digit_share": F.coalesce(F.try_divide(digits, size), F.lit(0.0)),
        "vowel_share": F.coalesce(F.try_divide(vowels, size), F.lit(0.0)),
        "char_entropy": entropy(name)})
    lean = (F.col("char_entropy") - F.lit(3.0) + F.lit(4.0) * F.col("digit_share")
            - F.lit(2.0) * F.col("vowel_share"))
    return out.withColumn("dga_score", 1 / (1 + F.exp(-lean)))


def domain_facts(flows: DataFrame, domains: DataFrame, column: str = "query") -> DataFrame:
    """Age in days and reputation of each flow's domain.

    Facts are matched per distinct name; the flows of a popular name are dealt out in slices.
    """
    facts = domains.select(F.col("domain").alias(column), "registered_us", "reputation")
    return counted_lookup(flows, facts, [column], ["uid"]).withColumn(
        "domain_age_days",
        F.floor((F.col("ts_us") - F.col("registered_us")) / F.lit(DAY_US)).cast("int")
    ).drop("registered_us")
