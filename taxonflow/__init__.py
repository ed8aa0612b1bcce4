"""taxonflow: sequence classification, taxonomy and set analytics as Spark plans."""

__version__ = "0.1.0"
