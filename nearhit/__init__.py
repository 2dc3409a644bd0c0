"""nearhit: similarity caching and embedding evaluation on Spark DataFrames.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects;
nothing is collected to the driver except scalars (row counts, sizes) used to
size blocks.
"""

from nearhit.session import get_session, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_session", "ensure_checkpoint_dir"]
