"""finelens: Spark-native checks and analytics for fine-tuning data and training runs.

Four workloads, all expressed as DataFrame plans:

* dataset validation (``operators.checks``)
* model-answer evaluation (``operators.evaluate``)
* run / metric / event analytics (``operators.metrics``, ``operators.report``)
* run catalogs and logs (``operators.runs``)

``plans`` wires them to the driver tables; ``streaming`` holds the
Structured Streaming forms of the mergeable checks.
"""

__all__ = ["session"]
