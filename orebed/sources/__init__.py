"""Sources of the orebed engine."""
