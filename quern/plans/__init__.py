"""Part of quern: plans."""
