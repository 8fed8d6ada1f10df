"""Table operations: write, check, match keys, manage and report."""
