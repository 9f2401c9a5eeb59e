"""driftnet: catalogue, enrich and search a corpus of files with PySpark."""

__version__ = "0.1.0"
