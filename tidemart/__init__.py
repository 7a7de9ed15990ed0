"""Commerce and subscription analytics written as Spark DataFrame plans."""

from tidemart.session import scratch_dir, tune

__all__ = ["scratch_dir", "tune"]
