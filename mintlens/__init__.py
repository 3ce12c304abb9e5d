"""mintlens: token-collection analytics on Spark.

Landed block documents and current-state snapshots in, activity feed, sales,
open work, market figures, wallet and display views out -- all as DataFrame,
SQL and Structured Streaming operators (see README.md for the layout).
"""

__version__ = "0.1.0"
