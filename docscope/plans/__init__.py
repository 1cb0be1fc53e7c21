"""Plan-level helpers: sessions, shipping and catalogues of queries."""
