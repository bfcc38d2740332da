"""DataFrame-to-DataFrame operators. They write nothing but small staged tables."""
