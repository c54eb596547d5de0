"""lorekeep: a PySpark-native analytics engine over event logs and text corpora."""

from lorekeep.session import get_session

__all__ = ["get_session"]
