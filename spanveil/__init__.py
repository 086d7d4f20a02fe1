"""spanveil: find, resolve, mask and restore sensitive spans in text columns with PySpark."""

__version__ = "0.1.0"
