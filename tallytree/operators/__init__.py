"""DataFrame operators over the filing star."""
