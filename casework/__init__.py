"""casework: cohort feature engineering, model search and attribution on Spark.

Every operator is a DataFrame transformation; data-dependent steps are
fit/transform pairs whose fit pass collects only a bounded summary.
"""

__version__ = "0.1.0"
