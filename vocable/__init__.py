"""vocable: speech/text corpus preparation as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` or ``Column -> Column``.
Randomness is keyed hashing (see ``vocable.functions.hashing``), so results are
reproducible and independent of partitioning.
"""

from vocable.session import ensure_checkpoint_dir, get_spark

__all__ = ["get_spark", "ensure_checkpoint_dir"]
