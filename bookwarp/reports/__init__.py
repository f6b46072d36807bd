"""reports of the engine."""
