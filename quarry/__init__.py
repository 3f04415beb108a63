"""quarry: corpus search and retrieval experiments as Spark DataFrame jobs.

Every public operator takes DataFrames (a corpus is any table with a path
and a text column) and returns a lazy DataFrame; nothing is collected.
"""

from quarry.session import get_session

__all__ = ["get_session"]
