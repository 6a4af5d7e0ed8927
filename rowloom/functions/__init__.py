"""functions of the posting-match engine."""
