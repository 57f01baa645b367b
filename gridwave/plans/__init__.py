"""Multi-step plans: walks and operator tables."""
