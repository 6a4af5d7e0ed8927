"""sources of the posting-match engine."""
