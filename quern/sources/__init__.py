"""Part of quern: sources."""
