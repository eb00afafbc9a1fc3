"""Text analysis and highlight functions."""
