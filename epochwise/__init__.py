"""epochwise: longitudinal trial and multi-arm experiment readouts as Spark jobs.

Every public operator takes DataFrames plus column names and returns a lazy
DataFrame.  Nothing here depends on a global session, and nothing but result
rows ever reaches the driver.
"""

__version__ = "0.1.0"
