"""Default parameters.

Everything here is a plain frozen dataclass, so a run is described by
``replace(Settings(), ...)`` and no operator reads global state.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Class names, label spellings, column roles and vendor column
# names that must be as they are for results to agree.
# ---------------------------------------------------------------------------
CLASS_ORDER = [
    "Benign", "PortScan", "DoS", "DDoS", "Brute Force", "Web Attack",
    "Infiltration", "Botnet", "Heartbleed",
]
BENIGN = "Benign"
RARE_CLASSES = ["Infiltration", "Heartbleed", "Web Attack", "Botnet"]
LABEL_GROUPS = {
    "benign": "Benign",
    "portscan": "PortScan",
    "dos hulk": "DoS",
    "dos goldeneye": "DoS",
    "dos slowloris": "DoS",
    "dos slowhttptest": "DoS",
    "ddos": "DDoS",
    "ftp-patator": "Brute Force",
    "ssh-patator": "Brute Force",
    "web attack brute force": "Web Attack",
    "web attack xss": "Web Attack",
    "web attack sql injection": "Web Attack",
    "infiltration": "Infiltration",
    "bot": "Botnet",
    "heartbleed": "Heartbleed",
}
UNLABELLED = ["", "nan", "none", "null", "na"]
IDENTIFIER_COLUMNS = [
    "Flow ID", "Source IP", "Destination IP", "Src IP", "Dst IP",
    "Timestamp", "Source Port", "Src Port",
]
DST_PORT_COLUMNS = ["Destination Port", "Dst Port"]
SENTINEL_COLUMNS = [
    "Init_Win_bytes_forward", "Init_Win_bytes_backward",
    "Init Fwd Win Bytes", "Init Bwd Win Bytes",
]
AFTERNOON_TOKENS = ["afternoon", "-afternoon", "_afternoon"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday"]
# ---------------------------------------------------------------------------


# Fixed value: start of the stand-in time axis.
SURROGATE_START = "2017-07-03 09:00:00"


@dataclass(frozen=True)
class SessionSettings:
    key_mode: str = "service_port"
    timeout_s: float = 1800.0
    max_flows: int = 200
    cap_mode: str = "block"
    # Rows of one key that a task takes; busier keys are cut into slices.
    slice_rows: int = 1_000_000


@dataclass(frozen=True)
class SplitSettings:
    strategy: str = "time_blocked"
    train_frac: float = 0.70
    val_frac: float = 0.15
    gap_frac: float = 0.005
    tiny_class_min_flows: int = 30
    tiny_class_policy: str = "flow_level"
    require_all_classes: bool = True
    seed: int = 42


@dataclass(frozen=True)
class Recipe:
    """A feature list to compare with the chosen one, read off a fusion of rankers.

    Without ``rankers`` all of the run are fused, without ``votes`` the run's
    threshold holds. ``read``: the first by "place", those of the "pool", by "votes", or "all".
    """

    name: str
    rankers: tuple = ()
    votes: int | None = None
    read: str = "place"


# Which rankers the comparison lists fuse, with how many votes.
RECIPES = (
    Recipe("every feature", read="all"),
    Recipe("information", ("mi",), 1),
    Recipe("tree ensembles", ("rfi", "boost"), 1),
    Recipe("spread and information", ("sd", "dmm", "mi"), 1),
    Recipe("permutation", ("pi_svm",), 1),
    Recipe("most votes", read="votes"),
    Recipe("votes, then rank", read="pool"),
    Recipe("base rankers", ("mi", "rfi", "pi_svm", "shap", "dmm", "sd"), 4, "pool"),
    Recipe("correlation", ("pearson",), 1),
    Recipe("components", ("pca",), 1),
)


@dataclass(frozen=True)
class SelectionSettings:
    variance_epsilon: float = 1.0e-5
    spearman_threshold: float = 0.95
    top_k: int = 30
    vote_threshold: int = 4
    n_grid: tuple = (10, 15, 20, 25, 30, 40, 50)
    delta: float = 0.005
    rankers: tuple = ("mi", "rfi", "pi_svm", "shap", "dmm", "sd", "boost", "sequence")
    base_rankers: tuple = ("mi", "rfi", "pi_svm", "shap", "dmm", "sd")
    mi_neighbors: int = 3
    # The *_max_rows below bound the labelled rows a ranker's or probe's model is fitted on
    # (stratified by class). Rows are scored and explained without a bound.
    rfi_trees: int = 200
    rfi_max_rows: int = 200_000
    svm_max_rows: int = 8_000
    svm_holdout_frac: float = 0.30
    svm_repeats: int = 3
    shap_trees: int = 50
    shap_fit_max_rows: int = 200_000
    boost_rounds: int = 50
    boost_depth: int = 6
    boost_max_rows: int = 300_000
    window: int = 10
    sequence_max_windows: int = 40_000
    probe_max_rows: int = 200_000
    probe_trees: int = 150
    stability_runs: int = 2
    stability_frac: float = 0.6
    recipes: tuple = RECIPES
    # Also compare with each ranker of the run left out, one vote less needed.
    leave_one_out: bool = True


@dataclass(frozen=True)
class ImbalanceSettings:
    mode: str = "both"
    k_neighbors: int = 5
    min_samples_for_smote: int = 6
    small_class_fallback: str = "random_oversample"
    # A bound on the rows of the largest class that go into resampling; None takes all.
    majority_cap: int | None = None
    enn_neighbors: int = 3
    target_strategy: str = "capped"
    max_oversample_ratio: int = 20
    protect_rare_classes: bool = True


@dataclass(frozen=True)
class ModelSettings:
    enabled: tuple = ("rf", "boost", "sequence", "neural", "graph")
    rf_trees: int = 200
    rf_depth: int = 20
    boost_rounds: int = 60
    boost_depth: int = 6
    boost_step: float = 0.1
    window: int = 10
    hidden: tuple = (64,)
    epochs: int = 40
    graph_hops: int = 2
    max_in_degree: int = 10
    edge_max_gap_s: float = 900.0
    # A bound on session edges; None uses all, so predictions never depend on how many rows are scored.
    max_edges: int | None = None


@dataclass(frozen=True)
class TemporalSettings:
    event_definition: str = "flow_state"
    bins: int = 3
    max_sequence_length: int = 50
    itemset_min_support: float = 0.02
    itemset_max_len: int = 4
    pattern_min_support: float = 0.02
    pattern_max_len: int = 5
    top_k_patterns: int = 200
    laplace_alpha: float = 0.1
    self_loops: bool = True
    min_events: int = 2


@dataclass(frozen=True)
class FusionSettings:
    temporal: bool = True
    context: str = "states"                 # or "label_graph": transitions of labels, followed by each model
    calibrators: tuple = (
        ("rf", "isotonic"), ("boost", "isotonic"), ("sequence", "isotonic"),
        ("neural", "temperature"), ("graph", "temperature"),
    )
    temperature_steps: int = 200
    lambdas: tuple = (0.5, 0.3, 0.2)
    lambda_step: float = 0.1
    threshold_points: int = 101
    threshold_objective: str = "macro_f1"
    target_false_alarm_rate: float = 0.01


@dataclass(frozen=True)
class EvaluationSettings:
    ece_bins: int = 15
    alpha: float = 0.05
    rare_classes: tuple = tuple(RARE_CLASSES)


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    benign: str = BENIGN
    classes: tuple = tuple(CLASS_ORDER)
    expect_min_rows: int = 2_000_000
    use_dst_port: bool = False
    session: SessionSettings = field(default_factory=SessionSettings)
    split: SplitSettings = field(default_factory=SplitSettings)
    selection: SelectionSettings = field(default_factory=SelectionSettings)
    imbalance: ImbalanceSettings = field(default_factory=ImbalanceSettings)
    models: ModelSettings = field(default_factory=ModelSettings)
    temporal: TemporalSettings = field(default_factory=TemporalSettings)
    fusion: FusionSettings = field(default_factory=FusionSettings)
    evaluation: EvaluationSettings = field(default_factory=EvaluationSettings)

    def with_(self, **parts) -> "Settings":
        """``settings.with_(session={"timeout_s": 60}, seed=7)``."""
        changes = {
            k: replace(getattr(self, k), **v) if isinstance(v, dict) else v
            for k, v in parts.items()
        }
        return replace(self, **changes)
