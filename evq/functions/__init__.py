"""Column helpers and the few physical patterns the operators share."""
