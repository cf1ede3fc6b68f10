"""Formula verification and evidence analytics as Spark queries."""
