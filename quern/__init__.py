"""Graph-condensation analytics and training-text operators as PySpark plans."""
