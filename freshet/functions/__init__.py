"""Column-level helpers: calendar, statistics, runs, distributed ranks, distributions."""
