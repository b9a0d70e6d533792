"""Column functions: names and titles, durations and years, word differences."""
