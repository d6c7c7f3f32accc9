"""Model data-flow on pyspark.ml: folds, out-of-fold scores, stacking, search."""
