"""cloudsift: Spark jobs for hunting through cloud audit data, as DataFrame operators."""
