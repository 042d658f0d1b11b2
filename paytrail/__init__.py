"""paytrail: order and payment analytics on Spark.

Subpackages: ``sources`` (tables, fixtures, sinks, model store), ``functions``
(column helpers), ``operators`` (reports, intake, events, fold, quality,
outbox), ``plans`` (registered queries, oracle SQL, SQL views) and
``streaming`` (the webhook fold as a Structured Streaming job).
"""

__version__ = "0.1.0"
