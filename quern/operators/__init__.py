"""Part of quern: operators."""
