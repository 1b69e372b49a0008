"""Place coverage, snapshotting and record linkage as Spark jobs."""

__version__ = "0.1.0"
