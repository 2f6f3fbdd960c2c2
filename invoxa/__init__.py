"""invoxa: invoice text extraction, code matching, response resolution and
scoring expressed as Spark DataFrame plans.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns). Nothing is collected to the driver.
"""

__version__ = "0.1.0"
