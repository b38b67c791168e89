"""Job wiring: configuration, the validation run and the findings table."""
