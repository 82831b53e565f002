"""quarry: exploratory analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; all heavy work is
expressed with Spark SQL built-ins so Catalyst plans it and whole-stage
codegen runs it.
"""

__version__ = "0.1.0"
