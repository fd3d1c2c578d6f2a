"""tidewright: a data-fusion analytics engine on PySpark.

Operators are plain ``DataFrame -> DataFrame`` functions; Catalyst picks the
physical plan.  See README.md for the layout and the query catalogue.
"""

__version__ = "0.1.0"
