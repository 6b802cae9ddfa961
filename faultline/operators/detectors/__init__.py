"""The 26 history detectors, and the registry users extend with their own."""

from faultline.operators.detectors.registry import DETECTORS, Detector, detect, detect_long, register
from faultline.operators.detectors import advanced, execution, resource, statistical  # noqa: F401  (registration)

__all__ = ["DETECTORS", "Detector", "detect", "detect_long", "register"]
