"""gridloom: spatio-temporal data cubes as Spark DataFrames.

Every public function takes and returns DataFrames (or Columns); nothing is
computed on the driver and nothing runs until an action is called.
"""

from gridloom.session import configure, session

__all__ = ["configure", "session"]
