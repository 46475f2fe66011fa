"""symlattice.plans."""
