"""marquee: booking and event-ticketing analytics as Spark DataFrame jobs.

Every public function takes DataFrames (usually the state dict ``st`` of the
eleven booking tables) and returns DataFrames; nothing is collected to the
driver except the undecided-row count that controls the allocation rounds.
"""

from marquee.session import get_spark, scratch_dir  # noqa: F401

__all__ = ["get_spark", "scratch_dir"]
