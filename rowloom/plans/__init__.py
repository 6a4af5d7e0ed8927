"""plans of the posting-match engine."""
