"""Advanced detectors: drift, cascades, starvation, security, dependencies, economic abuse."""

from faultline.operators.context import PHASE_SLOTS, span, std
from faultline.operators.detectors.registry import Detector, register


def _between(f: str, lo: str, hi: str) -> str:
    return f"(coalesce({hi}.{f}, 0) - coalesce({lo}.{f}, 0))"


def _drift(first: str, s: str) -> str:
    new = f"({first} + {_between(s, 'recent', 'p')} / nullif({_between('n', 'recent', 'p')}, 0))"
    old = f"({first} + {_between(s, 'ph', 'base')} / nullif({_between('n', 'ph', 'base')}, 0))"
    return _ratio(new, old)


def _ratio(new: str, old: str) -> str:
    return f"CASE WHEN {old} > 0 THEN least(abs({new} - {old}) / {old}, 2) WHEN {new} > 0 THEN 1D ELSE 0D END"


def _phases(lo: str, hi: str) -> str:
    return "(" + " + ".join(f"CAST({_between('ph_' + s, lo, hi)} > 0 AS DOUBLE)" for s in PHASE_SLOTS) + ")"


def _spread(lo: str, hi: str) -> str:
    return std(_between("n", lo, hi), _between("d", lo, hi), _between("d2", lo, hi))


# Last min(20, n/4) records against the first min(30, n/2) of the history.
register(Detector(
    "behavioral_drift", needs=("sums", "drift"), enough="n >= 50",
    steps={
        "bd_d": _drift("d0", "d"), "bd_m": _drift("m0", "m"), "bd_c": _drift("c0", "c"), "bd_w": _drift("w0", "w"),
        "bd_s": _ratio(_spread("recent", "p"), _spread("ph", "base")),
        "bd_p": _ratio(_phases("recent", "p"), _phases("ph", "base")),
        "bd_score": """(bd_d + bd_m + bd_c + bd_w + bd_s + bd_p) / 6 * 0.6D
                       + greatest(bd_d, bd_m, bd_c, bd_w, bd_s, bd_p) * 0.4D""",
    },
    detected="bd_score > 0.3", confidence="least(bd_score, 1)",
    kind="CASE WHEN bd_score > 0.3 THEN 'execution_failure' ELSE 'benign' END",
    features=("bd_d", "bd_m", "bd_c", "bd_w", "bd_s", "bd_p"),
))

# Failures of the last five minutes. With failures numbered 1..F in the key, sums of the number
# times the duration give the slope over any run of them; a gap counts only if both ends are recent.
register(Detector(
    "cascade_failure", needs=("sums", "fails", "a300i"),
    steps={
        "cf_n": span("f", "a300i"),
        "cf_rapid": "p.r - coalesce(a300i.r_from, 0)",
        "cf_y": span("fd", "a300i"),
        "cf_xy": f"{span('fx', 'a300i')} - (coalesce(a300i.f, 0) + 1) * cf_y",
        "cf_slope": """CASE WHEN cf_n > 2 THEN (cf_n * cf_xy - cf_n * (cf_n - 1) / 2 * cf_y)
                         / (cf_n * (cf_n - 1) * cf_n * (2 * cf_n - 1) / 6 - pow(cf_n * (cf_n - 1) / 2, 2)) ELSE 0D END""",
        "cf_score": """least(cf_n / 5, 1.5D) * 0.4D + least(cf_rapid / 3, 1D) * 0.4D
                       + CASE WHEN cf_slope > 0 THEN least(cf_slope / 5, 0.8D) ELSE 0D END * 0.2D""",
    },
    enough="n >= 10 AND cf_n > 0",
    detected="cf_score > 0.6", confidence="least(cf_score, 1)",
    kind="CASE WHEN cf_score > 0.6 THEN 'execution_failure' ELSE 'benign' END",
    features=("cf_n", "cf_rapid", "cf_slope"),
))

register(Detector(
    "resource_starvation", needs=("sums", "a10i"),
    steps={
        "sv_n": span("n", "a10i"),
        "sv_cpu": f"{span('c', 'a10i')} + sv_n * c0", "sv_mem": f"{span('m', 'a10i')} + sv_n * m0",
        "sv_score": """CASE WHEN duration > 5 THEN least(duration / 5, 3D) ELSE 0D END * 0.4D
                     + (CASE WHEN cpu_utilization < 10 THEN (10 - cpu_utilization) / 10 ELSE 0D END
                        + CASE WHEN memory_spike_kb < 5120 THEN (5120 - memory_spike_kb) / 5120 ELSE 0D END) * 0.4D
                     + (CASE WHEN sv_n > 2 AND sv_cpu > 200 THEN 0.5D ELSE 0D END
                        + CASE WHEN sv_n > 2 AND sv_mem > 102400 THEN 0.3D ELSE 0D END) * 0.2D""",
    },
    detected="sv_score > 0.5", confidence="least(sv_score, 1)",
    kind="CASE WHEN sv_score > 0.5 THEN 'starvation_fallback' ELSE 'benign' END",
    features=("sv_n", "sv_cpu", "sv_mem"),
))

register(Detector(
    "security_anomaly", needs=("net10",),
    steps={
        "se_spike": """CASE WHEN n < 10 THEN 0D
                            WHEN net10 > 0 THEN CASE WHEN network_io_bytes / net10 > 5
                                                     THEN least((network_io_bytes / net10 - 1) / 9, 0.5D) ELSE 0D END
                            WHEN network_io_bytes > 1048576 THEN 0.5D ELSE 0D END""",
        "se_score": """greatest(CASE WHEN network_io_bytes > 52428800 THEN least(network_io_bytes / 52428800, 2) ELSE 0D END,
                                CASE WHEN duration > 60 THEN least(duration / 60, 1.5D) ELSE 0D END,
                                CASE WHEN memory_spike_kb > 512000 THEN least(memory_spike_kb / 512000, 1) ELSE 0D END,
                                CASE WHEN execution_phase = 'error' THEN 0.3D ELSE 0D END, se_spike)""",
    },
    detected="se_score > 0.4", confidence="least(se_score, 1)",
    kind="""CASE WHEN network_io_bytes > 52428800 THEN 'network_anomaly'
                 WHEN se_score > 0.4 THEN 'execution_failure' ELSE 'benign' END""",
    features=("se_spike", "se_score"),
))

register(Detector(
    "dependency_failure", needs=("net5",),
    steps={
        # fixed values: common timeouts of 30 and 60 s (shorter ones cannot match beyond 30 s)
        "df_score": """greatest(CASE WHEN duration <= 30 THEN 0D
                                     WHEN abs(duration - 30) < 1 OR abs(duration - 60) < 1 THEN 0.8D
                                     ELSE least(duration / 60, 0.6D) END,
                                CASE WHEN execution_phase = 'error' THEN 0.6D ELSE 0D END,
                                CASE WHEN n >= 5 AND net5 > 10240 AND network_io_bytes < net5 * 0.1D THEN 0.7D ELSE 0D END,
                                CASE WHEN network_io_bytes < 1024 AND execution_phase <> 'error' THEN 0.4D ELSE 0D END)""",
    },
    detected="df_score > 0.4", confidence="df_score",
    kind="""CASE WHEN duration > 30 THEN 'timeout_fallback'
                 WHEN df_score > 0.4 THEN 'execution_failure' ELSE 'benign' END""",
    features=("df_score",),
))

register(Detector(
    "economic_abuse", needs=("sums", "a3600i", "gaps"),
    steps={
        "ea_hour": span("n", "a3600i"),
        "ea_freq": "CASE WHEN n >= 10 AND ea_hour > 1000 THEN least(ea_hour / 1000, 2) - 1 ELSE 0D END",
        "ea_regular": """CASE WHEN ea_freq > 0 AND n >= 20 AND gap_std < gap_avg * 0.1D AND gap_avg < 10
                              THEN 0.5D ELSE 0D END""",
        "ea_cost": "duration * 0.001D + memory_spike_kb / 1048576 * 0.01D + network_io_bytes / 1048576 * 0.001D",
        "ea_score": """greatest(CASE WHEN duration > 300 THEN least(duration / 300, 2D) ELSE 0D END,
                                CASE WHEN memory_spike_kb > 1048576 THEN least(memory_spike_kb / 1048576, 2) ELSE 0D END,
                                CASE WHEN cpu_utilization > 95 THEN least(cpu_utilization / 95, 1.5D) ELSE 0D END,
                                CASE WHEN network_io_bytes > 104857600 THEN least(network_io_bytes / 104857600, 1.5) ELSE 0D END,
                                ea_freq, CASE WHEN ea_cost > 5 THEN least(ea_cost / 10, 1D) ELSE 0D END)
                       + ea_regular * 0.3D""",
    },
    detected="ea_score > 0.6", confidence="least(ea_score, 1)",
    kind="CASE WHEN ea_score > 0.6 THEN 'billing_abuse' ELSE 'benign' END",
    features=("ea_hour", "ea_freq", "ea_regular", "ea_cost"),
))
