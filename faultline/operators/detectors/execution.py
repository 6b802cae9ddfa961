"""Execution detectors: phase patterns, cold starts, timeouts, error clusters, regressions, concurrency."""

from faultline.operators.context import span, std
from faultline.operators.detectors.registry import Detector, register

register(Detector(
    "execution_pattern", needs=("phase",), enough="n >= 15",
    steps={
        "ep_std": std("pp.k", "pp.s", "pp.s2"),
        "ep_z": "CASE WHEN pp.k > 3 AND ep_std > 0 THEN abs(duration - d0 - pp.s / pp.k) / ep_std ELSE 0D END",
        "ep_score": "greatest(CASE WHEN pp.k / n < 0.05 THEN 0.5D ELSE 0D END, least(ep_z / 3, 1))",
    },
    detected="ep_score > 0.4", confidence="ep_score",
    kind="CASE WHEN ep_score > 0.4 THEN 'execution_failure' ELSE 'benign' END", features=("ep_z", "ep_score"),
))

register(Detector(
    "cold_start", needs=("prev",),
    steps={
        "cs_gap": "coalesce((ts_us - prev_ts) / 1000000, 0)",
        "cs_score": """CASE WHEN duration > 1 THEN least(duration, 2D) ELSE 0D END * 0.4D
                     + CASE WHEN memory_spike_kb > 20480 THEN least(memory_spike_kb / 20480, 1.5D) ELSE 0D END * 0.3D
                     + CASE WHEN execution_phase = 'init' THEN 1D ELSE 0D END * 0.2D
                     + CASE WHEN cs_gap > 300 THEN least(cs_gap / 600, 1D) ELSE 0D END * 0.1D""",
    },
    detected="cs_score > 0.5", confidence="least(cs_score, 1)",
    kind="CASE WHEN cs_score > 0.5 THEN 'cold_start' ELSE 'benign' END", features=("cs_gap", "cs_score"),
))

register(Detector(
    "timeout_pattern", needs=("max_dur",),
    steps={
        # fixed values: usual timeouts of 15, 30, 60, 120, 300 and 900 s. The first one whose 90%
        # is exceeded is always the 15 s one.
        "tp_limit": """CASE WHEN duration > 15 * 0.9D THEN 15D
                            WHEN n > 20 AND duration > max_dur * 0.95D THEN max_dur * 1.1D END""",
        "tp_score": """greatest(CASE WHEN tp_limit > 0 THEN greatest(0, duration / tp_limit - 0.9D) / (1 - 0.9D) ELSE 0D END,
                                CASE WHEN execution_phase = 'error' THEN 0.7D ELSE 0D END)""",
    },
    detected="tp_score > 0.3", confidence="least(tp_score, 1)",
    kind="CASE WHEN tp_score > 0.3 THEN 'timeout_fallback' ELSE 'benign' END", features=("tp_limit", "tp_score"),
))

# Recent errors include long durations, the historical rate does not.
register(Detector(
    "error_clustering", needs=("sums", "fails", "a600i"),
    steps={
        "ec_n": span("n", "a600i"), "ec_rate": f"{span('f', 'a600i')} / nullif(ec_n, 0)", "ec_base": f"{span('e')} / n",
        "ec_ratio": "CASE WHEN ec_base > 0 THEN ec_rate / ec_base ELSE ec_rate * 10 END",
        "ec_score": "CASE WHEN ec_rate > 0.1 THEN least(ec_ratio, 3) / 3 ELSE 0D END",
    },
    enough="n >= 10 AND ec_n >= 5",
    detected="ec_score > 0.3", confidence="ec_score",
    kind="CASE WHEN ec_score > 0.3 THEN 'execution_failure' ELSE 'benign' END",
    features=("ec_rate", "ec_base", "ec_ratio"),
))


def _rise(first: str, s: str, pad: str) -> str:
    """Relative rise of the second half's mean over the first half's, 0 up to 10%."""
    old = f"({first} + (half.{s} - coalesce(ph.{s}, 0)) / nullif(half.n - coalesce(ph.n, 0), 0))"
    new = f"({first} + {span(s, 'half')} / nullif({span('n', 'half')}, 0))"
    rise = f"(({new} - {old}) / ({old} + {pad}))"
    return f"CASE WHEN {rise} > 0.1 THEN {rise} ELSE 0D END"


register(Detector(
    "performance_regression", needs=("sums", "half"), enough="n >= 20",
    steps={
        "pr_d": _rise("d0", "d", "0.001"), "pr_m": _rise("m0", "m", "1"), "pr_c": _rise("c0", "c", "1"),
        "pr_score": "pr_d * 0.5D + pr_m * 0.3D + pr_c * 0.2D",
    },
    detected="pr_score > 0.15", confidence="least(pr_score / 0.3, 1)",
    kind="CASE WHEN pr_score > 0.15 THEN 'execution_failure' ELSE 'benign' END", features=("pr_d", "pr_m", "pr_c"),
))

register(Detector(
    "concurrency_anomaly", needs=("sums", "a5i"),
    steps={
        "ca_all": span("n", "a5i"),
        "ca_mem": f"{span('m', 'a5i')} + ca_all * m0", "ca_cpu": f"{span('c', 'a5i')} + ca_all * c0",
        "ca_dur": f"d0 + {span('d', 'a5i')} / ca_all",
        "ca_score": """greatest(CASE WHEN ca_all > 3 THEN least((ca_all - 1) / 5, 2) ELSE 0D END,
                                CASE WHEN ca_mem > 204800 THEN least(ca_mem / 204800, 1.5) ELSE 0D END,
                                CASE WHEN ca_cpu > 300 THEN least(ca_cpu / 300, 1.5) ELSE 0D END)
                       + CASE WHEN ca_all > 1 THEN least(ca_dur / 2, 1) ELSE 0D END * 0.3D""",
    },
    detected="ca_score > 0.6", confidence="least(ca_score / 1.5, 1)",
    kind="CASE WHEN ca_score > 0.6 THEN 'starvation_fallback' ELSE 'benign' END",
    features=("ca_all", "ca_mem", "ca_cpu"),
))
