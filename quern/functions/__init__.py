"""Part of quern: functions."""
