"""vigil — Spark-native analytics for logs, metrics and trace spans.

Everything is expressed as DataFrame / Spark SQL operators so Catalyst plans
them and the cluster runs them; see README.md for the module map.
"""

from vigil.session import configure, get_session

__all__ = ["configure", "get_session"]
