"""sources of quirelab."""
