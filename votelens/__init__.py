"""Quality assurance of preference annotations on Spark."""
