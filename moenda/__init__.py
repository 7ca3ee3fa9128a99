"""moenda: corpus preparation for language-model training, as Spark DataFrame transforms."""

__version__ = "0.1.0"
