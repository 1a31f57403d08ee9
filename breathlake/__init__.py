"""breathlake: physiological time series and feature tables on Spark.

Every public operator takes DataFrames and returns a DataFrame, is lazy unless
its docstring says otherwise, and treats NULL as the only missing value.
"""

__version__ = "0.1.0"
