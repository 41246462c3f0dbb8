"""Customer-360 analytics on Spark DataFrames.

Every operator is a function from DataFrames plus column names to a DataFrame;
nothing in the package runs a Spark job unless its docstring says so.
"""

from ledgerloom.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
