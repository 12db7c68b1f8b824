"""plans of quirelab."""
