"""Tables of fingerprints from files and from other columns."""
