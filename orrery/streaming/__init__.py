"""Extension: history that grows as commits come in (the study itself has no streams)."""
