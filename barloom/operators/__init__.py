"""DataFrame operators over panels."""
