"""Part of quern: streaming."""
