"""folioscope: document and manifest analytics as PySpark DataFrame operators."""
