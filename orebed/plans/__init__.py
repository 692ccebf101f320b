"""Plans of the orebed engine."""
