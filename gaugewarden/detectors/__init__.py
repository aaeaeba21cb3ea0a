from .registry import DETECTORS, Detector, check_columns, register

__all__ = ["DETECTORS", "Detector", "check_columns", "register"]
