"""streaming of the posting-match engine."""
