"""The registered queries: library operators bound to the driver's tables, with SQL oracles."""
