"""Statistical detectors: outliers, deviations, correlation, trend, frequency, percentiles."""

from faultline.operators.context import span, std
from faultline.operators.detectors.registry import Detector, register


def _z(value: str, first: str, s: str) -> str:
    """Deviation of the current value from the history before it; null when that is constant."""
    n = "(n - 1)"
    cur = f"({value} - {first})"
    s1 = f"({span(s)} - {cur})"
    s2 = f"({span(s + '2')} - {cur} * {cur})"
    sd = std(n, s1, s2)
    return f"abs({cur} - {s1} / nullif({n}, 0)) / nullif({sd}, 0)"


_Z = {
    "z_duration": _z("duration", "d0", "d"),
    "z_memory": _z("memory_spike_kb", "m0", "m"),
    "z_cpu": _z("cpu_utilization", "c0", "c"),
    "z_network": _z("network_io_bytes", "w0", "w"),
    "z_max": "coalesce(greatest(z_duration, z_memory, z_cpu, z_network), 0)",
    "z_kind": """CASE WHEN z_max <= 2.5 THEN 'benign'
                      WHEN z_duration = z_max THEN 'timeout_fallback' WHEN z_memory = z_max THEN 'memory_spike'
                      WHEN z_cpu = z_max THEN 'cpu_burst' ELSE 'network_anomaly' END""",
}

register(Detector(
    "statistical_outlier", needs=("sums",), enough="n >= 10", steps=_Z,
    detected="z_max > 2.5", confidence="least(z_max / 5, 1)", kind="z_kind",
    features=("z_duration", "z_memory", "z_cpu", "z_network"),
))

# With 50 records or more a forest decides, and its gate on the absolute decision score (0.6)
# cannot be met by an outlier; see operators.forest for forest scores as such.
register(Detector(
    "isolation_forest", needs=("sums",), enough="n >= 10 AND n < 50", steps=_Z,
    detected="z_max > 2.5", confidence="least(z_max / 5, 1)", kind="z_kind", features=("z_max",),
))

register(Detector(
    "temporal_deviation", needs=("sums", "a3600"),
    steps={
        "td_n": span("n", "a3600"), "td_old": f"{span('n')} - td_n",
        "td_recent": f"{span('d', 'a3600')} / nullif(td_n, 0)",
        "td_s": f"{span('d')} - {span('d', 'a3600')}", "td_s2": f"{span('d2')} - {span('d2', 'a3600')}",
        "td_sd": f"CASE WHEN td_old > 0 THEN {std('td_old', 'td_s', 'td_s2')} END",
        "td_score": "CASE WHEN td_sd > 0 THEN abs(td_recent - td_s / td_old) / td_sd ELSE 0D END",
    },
    enough="n >= 20 AND td_n >= 10 AND td_old > 0",
    detected="td_score > 2", confidence="least(td_score / 4, 1)",
    kind="CASE WHEN td_score > 2 THEN 'timeout_fallback' ELSE 'benign' END", features=("td_score",),
))

_N = span("n")


def _corr(x: str, y: str) -> str:
    sx, sy = span(x), span(y)
    cov = f"({_N} * {span(x + y)} - {sx} * {sy})"
    vx = f"({_N} * {span(x + '2')} - {sx} * {sx})"
    vy = f"({_N} * {span(y + '2')} - {sy} * {sy})"
    flat = f"({vx} <= 1e-12 * {_N} * {span(x + '2')} OR {vy} <= 1e-12 * {_N} * {span(y + '2')})"
    return f"CASE WHEN {flat} THEN 0D ELSE {cov} / sqrt({vx} * {vy}) END"


# The correlation coefficient itself serves as the slope of the expected value.
register(Detector(
    "correlation_break", needs=("sums",), enough="n >= 30",
    steps={
        "cb_dm": _corr("d", "m"), "cb_dc": _corr("d", "c"),
        "cb_d": f"d0 + ({span('d')} - (duration - d0)) / nullif(n - 1, 0)",
        "cb_m": f"m0 + ({span('m')} - (memory_spike_kb - m0)) / nullif(n - 1, 0)",
        "cb_c": f"c0 + ({span('c')} - (cpu_utilization - c0)) / nullif(n - 1, 0)",
        "cb_score": """greatest(abs(memory_spike_kb - (cb_m + cb_dm * (duration - cb_d))) / (cb_m + 1),
                                abs(cpu_utilization - (cb_c + cb_dc * (duration - cb_d))) / (cb_c + 1))""",
    },
    detected="cb_score > 0.5", confidence="least(cb_score, 1)",
    kind="CASE WHEN cb_score > 0.5 THEN 'execution_failure' ELSE 'benign' END",
    features=("cb_dm", "cb_dc", "cb_score"),
))

register(Detector(
    "seasonal_deviation", needs=("hour",), enough="hh.k >= 5",
    steps={
        "sd_std": std("hh.k", "hh.s", "hh.s2"),
        "sd_z": "CASE WHEN sd_std > 0 THEN abs(duration - d0 - hh.s / hh.k) / sd_std ELSE 0D END",
    },
    detected="sd_z > 2.5", confidence="least(sd_z / 5, 1)",
    kind="CASE WHEN sd_z > 2.5 THEN 'timeout_fallback' ELSE 'benign' END", features=("sd_z",),
))

register(Detector(
    "trend_change", needs=("dur20",), enough="n >= 20",
    steps={"tc_slope": "round(abs(dur20_slope), 9)"},  # else noise decides whether a slope of just 0.01 is above it
    detected="tc_slope > 0.01", confidence="least(tc_slope / 0.02, 1)",
    kind="CASE WHEN tc_slope > 0.01 THEN 'timeout_fallback' ELSE 'benign' END", features=("dur20_slope",),
))

register(Detector(
    "frequency_anomaly", needs=("sums", "a300i", "samples"), enough="n >= 100 AND samples.k > 0",
    steps={
        "fa_now": span("n", "a300i"), "fa_mean": "samples.f / nullif(samples.k, 0)",
        "fa_std": std("samples.k", "samples.f", "samples.f2"),
        "fa_z": "CASE WHEN fa_std > 0 THEN abs(fa_now - fa_mean) / fa_std ELSE 0D END",
    },
    detected="fa_z > 2", confidence="least(fa_z / 4, 1)",
    kind="""CASE WHEN fa_z > 2 AND fa_now * samples.k > samples.f * 2 THEN 'billing_abuse'
                 WHEN fa_z > 2 THEN 'execution_failure' ELSE 'benign' END""",
    features=("fa_now", "fa_mean", "fa_z"),
))

register(Detector(
    "duration_outlier", needs=("pct",), enough="n >= 20",
    steps={
        "do_conf": """CASE WHEN duration > q.p99 THEN least((duration - q.p99) / (q.p99 - q.p50 + 0.001), 1)
                           WHEN duration < q.p1 THEN least((q.p1 - duration) / (q.p50 - q.p1 + 0.001), 1)
                           WHEN duration > q.p95 THEN least((duration - q.p95) / (q.p99 - q.p95 + 0.001), 0.7)
                           WHEN duration < q.p5 THEN least((q.p5 - duration) / (q.p5 - q.p1 + 0.001), 0.5)
                           ELSE 0D END""",
    },
    detected="do_conf > 0.3", confidence="do_conf",
    kind="""CASE WHEN duration > q.p99 THEN 'timeout_fallback' WHEN duration < q.p1 THEN 'execution_failure'
                 WHEN duration > q.p95 THEN 'cpu_burst' WHEN duration < q.p5 THEN 'cold_start' ELSE 'benign' END""",
    features=("q.p1", "q.p5", "q.p50", "q.p95", "q.p99"),
))
