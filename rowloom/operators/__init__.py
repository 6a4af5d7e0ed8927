"""operators of the posting-match engine."""
