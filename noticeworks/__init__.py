"""noticeworks: analytics over public vacancy notices, expressed as Spark plans."""

__version__ = "0.1.0"
