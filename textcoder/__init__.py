"""Text coding on Spark: assign codes of a hierarchical classification to short texts."""

__version__ = "0.1.0"
