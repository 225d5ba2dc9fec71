"""Hand-made flows: one exact beacon and one irregular session."""

import random

COLUMNS = ("ts double, ts_us bigint, uid string, orig_h string, orig_p int, resp_h string, "
           "resp_p int, proto string, service string, duration double, orig_bytes bigint, "
           "resp_bytes bigint, conn_state string, history string, orig_pkts bigint, "
           "orig_ip_bytes bigint, resp_pkts bigint, resp_ip_bytes bigint, detailed_label string, "
           "capture_id string")
START = 1_600_000_000


def beacon(n=6, gap=60, orig="10.1.0.5", resp="198.51.100.7", port=443, label="C&C-HeartBeat"):
    return [(float(START + i * gap), (START + i * gap) * 1_000_000, f"B{orig}{port}{i:06d}", orig,
             50000 + i, resp, port, "tcp", None, 0.05, 120, 0, "SF", "ShAdD", 3, 180, 1, 40, label,
             "one") for i in range(n)]


def irregular(n=6, seed=1, orig="10.1.0.6", resp="203.0.113.9", port=443, label="Benign"):
    rng, out, at = random.Random(seed), [], START * 1_000_000
    for i in range(n):
        out.append((at / 1e6, at, f"N{orig}{port}{seed}-{i:06d}", orig, 40000 + i, resp, port, "tcp",
                    "ssl", rng.uniform(0.5, 5), rng.randint(500, 5000), rng.randint(2000, 50000),
                    "SF", "ShADadFf", rng.randint(3, 30), rng.randint(600, 6000),
                    rng.randint(3, 40), rng.randint(2500, 60000), label, "two"))
        at += int(rng.uniform(5, 4000) * 1_000_000)
    return out


def flows(spark, *groups):
    return spark.createDataFrame([r for g in (groups or (beacon(), irregular())) for r in g], COLUMNS)
