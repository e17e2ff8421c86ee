"""carrisk — carrier safety-risk analytics on Spark.

Raw registry / inspection / violation / crash tables are cleaned, rolled
up to one row per carrier, merged, imputed and featurised (``plans.master``);
reports, a random-forest comparison (``plans.q1``) and a K-means
segmentation (``plans.q2``) run on that master.  Every step is a
DataFrame or Spark ML job.
"""

__all__ = ["functions", "operators", "plans", "sources"]
