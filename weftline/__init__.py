"""weftline: connectivity analytics for multivariate time series on Apache Spark.

The contract between layers is the panel: one row per time position ``t`` with one
double column per channel (or its long form ``t, channel, value``).  Metrics return
``edges``: ``src, dst, value`` plus whatever sweep columns (lag, window) were asked for.
"""

from weftline.panel import Panel
from weftline.session import local_session, tune

__all__ = ["Panel", "local_session", "tune"]
