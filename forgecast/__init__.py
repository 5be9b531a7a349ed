"""forgecast: procurement price forecasting as Spark DataFrame jobs.

Feature engineering, splits, per-item and pooled boosted-tree training,
recursive forecasting and request scoring are expressed over *all* items at
once with the DataFrame API; Python runs only inside Arrow-batched tasks
(tree fitting and tree scoring).
"""

__version__ = "0.1.0"
