"""Functions of the orebed engine."""
