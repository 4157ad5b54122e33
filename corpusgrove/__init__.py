"""corpusgrove: group and explore large collections of short texts on Spark.

Every public function takes and returns DataFrames; nothing corpus-sized is
gathered on the driver.
"""

__version__ = "0.1.0"
