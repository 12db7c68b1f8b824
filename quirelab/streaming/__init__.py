"""streaming of quirelab."""
