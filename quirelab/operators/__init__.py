"""operators of quirelab."""
