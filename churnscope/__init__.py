"""churnscope: structural churn analytics as Spark DataFrame functions.

Every operator takes and returns DataFrames. Operators that learn from data
(percentile caps, state thresholds, one-hot levels, reference vectors) are
split into a ``fit_*`` step returning a small model DataFrame and an
``apply_*`` step that is a lazy projection, so the same code runs on a
fixture or on a large partitioned table.
"""

__version__ = "0.1.0"
