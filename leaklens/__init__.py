"""leaklens: log-leak analytics for plugin ecosystems on Spark.

Library functions take DataFrames and return DataFrames.  Nothing in the
library collects facts to the driver; actions happen only where a caller
asks for a result (tests, bench, the driver's verify).
"""

from leaklens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
