"""Document analytics on Spark: comparison, repair, structure, layout and rendering of digitised texts."""

__version__ = "0.1.0"
