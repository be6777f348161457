"""tablewright: declarative table-mapping operators on Spark DataFrames.

Every operator is a function ``DataFrame(s) -> DataFrame`` or ``-> Column``;
Spark (Catalyst + AQE) plans and distributes the work.
"""

from tablewright.session import get_session, checkpoint_root

__all__ = ["get_session", "checkpoint_root"]
__version__ = "0.1.0"
