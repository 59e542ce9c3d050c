"""Set-at-a-time operators."""
