"""orebed: content-addressed assets, reproducible transforms and corpus operators on Spark."""
