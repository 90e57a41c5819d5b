"""driftlab: robustness analytics for binary classifiers, as PySpark DataFrame jobs."""
