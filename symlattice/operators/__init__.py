"""symlattice.operators."""
