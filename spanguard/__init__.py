"""spanguard: PySpark-native detection, reversible pseudonymization and audit of sensitive text spans."""

__version__ = "0.1.0"
