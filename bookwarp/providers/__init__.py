"""providers of the engine."""
