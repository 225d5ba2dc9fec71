"""Settings of a run, passed explicitly; nothing here is global state."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Column layout of the native connection log, in file order.
NATIVE_LOG_COLUMNS = (
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service",
    "duration", "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp",
    "missed_bytes", "history", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
    "tunnel_parents", "label", "detailed-label",
)

# Log columns that must be numbers, with the type each is read as.
NUMERIC_TYPES = {
    "ts": "double", "orig_p": "int", "resp_p": "int", "duration": "double",
    "orig_bytes": "bigint", "resp_bytes": "bigint", "missed_bytes": "bigint",
    "orig_pkts": "bigint", "orig_ip_bytes": "bigint", "resp_pkts": "bigint",
    "resp_ip_bytes": "bigint",
}

REQUIRED_COLUMNS = ("ts", "uid", "orig_h", "orig_p", "resp_h", "resp_p")

# Which detailed labels count as positive, negative, excluded.
POSITIVE_LABELS = (
    "C&C", "C&C-HeartBeat", "C&C-FileDownload", "C&C-HeartBeat-FileDownload",
    "C&C-Torii", "C&C-Mirai",
)
NEGATIVE_LABELS = ("Benign",)
EXCLUDED_LABELS = (
    "DDoS", "Okiru", "Okiru-Attack", "Attack", "PartOfAHorizontalPortScan", "FileDownload",
)

# Ports of well-known services and the first ephemeral port.
COMMON_SERVICE_PORTS = (
    20, 21, 22, 23, 25, 53, 80, 110, 143, 443, 445, 993, 995, 3389, 8080, 8443,
)
EPHEMERAL_PORT_FLOOR = 49152

SESSION_KEYS = ("orig_h", "resp_h", "resp_p")

# Names of the session features, by visibility tier.
TIMING_FEATURES = (
    "iat_mean", "iat_std", "iat_cv", "iat_median", "iat_min", "iat_max", "iat_mad",
    "periodicity_score", "fft_dominant_power", "session_flow_count", "session_span_hours",
    "duty_cycle", "hour_of_day", "is_weekend",
)
VOLUME_FEATURES = (
    "orig_resp_byte_ratio", "total_bytes", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts",
    "pkt_ratio", "mean_pkt_size_orig", "mean_pkt_size_resp", "bytes_per_second",
    "resp_bytes_is_zero", "session_byte_variance", "duration",
)
STATE_CATEGORIES = ("conn_state_mode", "proto_mode", "service_mode")
STATE_FEATURES = (
    "history_len", "history_has_S", "history_has_D", "resp_port", "is_ephemeral_orig_port",
    "is_common_service_port",
)
CONTEXT_FEATURES = ("dest_fanin", "src_fanout", "dest_flow_count")
LOG_SCALED_FEATURES = ("orig_bytes", "resp_bytes", "total_bytes")

TIERS = {"tier1": TIMING_FEATURES, "tier2": VOLUME_FEATURES, "tier4": CONTEXT_FEATURES}
NUMERIC_FEATURES = TIMING_FEATURES + VOLUME_FEATURES + STATE_FEATURES + CONTEXT_FEATURES


@dataclass(frozen=True)
class Settings:
    """Every threshold and hyper-parameter of a run. The defaults are fixed values."""

    seed: int = 42
    session_keys: tuple[str, ...] = SESSION_KEYS
    min_session_flows: int = 4
    # A session above this many flows is spread over several tasks instead of
    # being gathered into one array.
    hot_session_flows: int = 1_000_000
    positive_labels: tuple[str, ...] = POSITIVE_LABELS
    negative_labels: tuple[str, ...] = NEGATIVE_LABELS
    excluded_labels: tuple[str, ...] = EXCLUDED_LABELS
    # Column that stands in for a missing detailed label; None drops such flows.
    label_fallback: str | None = None
    rare_class_min_count: int = 50
    working_sample_size: int | None = None
    log_scaled: tuple[str, ...] = LOG_SCALED_FEATURES
    split_ratios: tuple[float, float, float] = (0.70, 0.15, 0.15)
    held_out_fraction: float = 0.3
    alerts_per_day: int = 50
    flows_per_day: int = 1000
    supervised_weight: float = 0.6
    anomaly_weight: float = 0.4
    fusion_method: str = "weighted_average"
    imbalance: str = "class_weight"
    focal_gamma: float = 2.0
    smote_neighbours: int = 5
    cv_folds: int = 5
    calibration: str = "isotonic"
    benign_percentile: float = 95.0
    jitter_levels: tuple[int, ...] = (0, 10, 20, 30, 40, 50)
    padding_levels: tuple[float, ...] = (1.0, 1.25, 1.5, 2.0)
    ablation_tiers: tuple[tuple[str, ...], ...] = (
        ("tier1",), ("tier1", "tier2"), ("tier1", "tier2", "tier4"),
    )
    forest_trees: tuple[int, ...] = (200, 400, 800)
    forest_depth: tuple[int | None, ...] = (8, 16, None)
    forest_min_leaf: tuple[int, ...] = (1, 4, 8)
    boost_rounds: tuple[int, ...] = (200, 400)
    boost_depth: tuple[int, ...] = (4, 6, 8)
    boost_step: tuple[float, ...] = (0.05, 0.1, 0.2)
    logistic_c: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)
    autoencoder_hidden: tuple[int, ...] = (32, 16, 8, 16, 32)
    autoencoder_dropout: float = 0.1
    autoencoder_rate: float = 0.001
    autoencoder_epochs: int = 100
    autoencoder_patience: int = 10
    autoencoder_batch: int = 256
    #: Times a lane goes over its rows before weights are averaged.
    autoencoder_inner_passes: int = 10

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


DEFAULTS = Settings()
