"""Part of kerbside."""
