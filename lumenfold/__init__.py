"""lumenfold: a PySpark-native analytics engine for visual-identification data."""

from lumenfold.session import EngineConfig, build_session

__all__ = ["EngineConfig", "build_session"]
