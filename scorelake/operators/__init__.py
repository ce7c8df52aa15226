"""Dataset operators: suites, audits, statistics and comparisons."""
