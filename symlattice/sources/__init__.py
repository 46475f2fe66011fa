"""symlattice.sources."""
