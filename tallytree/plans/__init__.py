"""Whole reports, the derived sample star and the query catalogue."""
