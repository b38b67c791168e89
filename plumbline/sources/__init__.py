"""Table readers, dataset profile and result writers."""
