"""symlattice.functions."""
