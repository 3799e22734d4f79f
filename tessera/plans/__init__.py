"""Multi-step plans that several operators share."""
