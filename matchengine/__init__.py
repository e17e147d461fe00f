"""matchengine: record matching on measured data, expressed as Spark plans."""

__version__ = "0.1.0"
