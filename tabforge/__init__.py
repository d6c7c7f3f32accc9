"""tabforge: labelled tabular data preparation, augmentation and scoring on Spark.

Every operator takes and returns a DataFrame; statistics (never data rows) are
the only values that pass through the driver.
"""

__version__ = "0.1.0"
