"""Resource detectors: spikes, leaks, bursts, I/O, network, storage."""

from faultline.operators.context import span, std
from faultline.operators.detectors.registry import Detector, register


def _spike(value: str, limit: str) -> str:
    return f"CASE WHEN {value} > {limit} THEN least({value} / {limit}, 3) - 1 ELSE 0D END"


register(Detector(
    "resource_spike",
    steps={
        "rs_memory": _spike("memory_spike_kb", "102400D"), "rs_cpu": _spike("cpu_utilization", "80D"),
        "rs_network": _spike("network_io_bytes", "10485760D"), "rs_max": "greatest(rs_memory, rs_cpu, rs_network)",
    },
    detected="rs_max > 0.5", confidence="least(rs_max / 2, 1)",
    kind="""CASE WHEN rs_max <= 0.5 THEN 'benign' WHEN rs_memory = rs_max THEN 'memory_spike'
                 WHEN rs_cpu = rs_max THEN 'cpu_burst' ELSE 'network_anomaly' END""",
    features=("rs_memory", "rs_cpu", "rs_network"),
))

register(Detector(
    "memory_leak", needs=("mem10",), enough="n >= 10",
    steps={"ml_score": "mem10_slope / (mem10 + 1) * (mem_rises / 9) * 10"},
    detected="ml_score > 0.3 AND mem10_slope > 1000", confidence="least(ml_score, 1)",
    kind="CASE WHEN ml_score > 0.3 AND mem10_slope > 1000 THEN 'memory_spike' ELSE 'benign' END",
    features=("mem10_slope", "ml_score"),
))

register(Detector(
    "cpu_burst", needs=("cpu5",),
    steps={
        "cp_ratio": "CASE WHEN n >= 5 THEN cpu_utilization / (cpu5 + 1) ELSE 1D END",
        "cp_score": """(greatest(0, cpu_utilization - 75) / 25
                        + CASE WHEN cp_ratio > 1.5 THEN least(cp_ratio - 1, 2) / 2 ELSE 0D END) / 2""",
    },
    detected="cp_score > 0.3", confidence="least(cp_score, 1)",
    kind="CASE WHEN cp_score > 0.3 THEN 'cpu_burst' ELSE 'benign' END", features=("cp_ratio", "cp_score"),
))

register(Detector(
    "io_intensive",
    steps={
        "io_rate": "network_io_bytes / greatest(duration, 0.001D)",
        "io_score": """least(io_rate / 1048576, 2) * CASE WHEN duration > 1 THEN least(duration / 2, 1.5D) ELSE 1D END""",
    },
    detected="io_score > 1.2", confidence="least(io_score / 2, 1)",
    kind="CASE WHEN io_score > 1.2 THEN 'io_intensive' ELSE 'benign' END", features=("io_rate", "io_score"),
))

register(Detector(
    "network_anomaly", needs=("sums", "pct"), enough="n >= 10",
    steps={
        "na_mean": f"w0 + {span('w')} / n", "na_std": std("n", span("w"), span("w2")),
        "na_z": "CASE WHEN na_std > 0 THEN abs(network_io_bytes - na_mean) / na_std ELSE 0D END",
        "na_high": """CASE WHEN network_io_bytes > q.net95
                           THEN least((network_io_bytes - q.net95) / (q.net95 + 1), 2) ELSE 0D END""",
        "na_zero": "CASE WHEN network_io_bytes = 0 AND na_mean > 1000 THEN 0.5D ELSE 0D END",
        "na_score": "greatest(na_z / 3, na_high / 2, na_zero)",
    },
    detected="na_score > 0.4", confidence="least(na_score, 1)",
    kind="CASE WHEN na_score > 0.4 THEN 'network_anomaly' ELSE 'benign' END",
    features=("na_z", "na_high", "na_zero"),
))

register(Detector(
    "storage_anomaly",
    steps={
        "st_score": """greatest(CASE WHEN duration > 2 THEN least(memory_spike_kb / 51200, 2) ELSE 0D END,
                                least(memory_spike_kb / greatest(duration, 0.001D) / 102400, 2))""",
    },
    detected="st_score > 0.6", confidence="least(st_score / 1.5, 1)",
    kind="CASE WHEN st_score > 0.6 THEN 'memory_spike' ELSE 'benign' END", features=("st_score",),
))
