"""symlattice.streaming."""
