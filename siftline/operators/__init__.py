"""The search database and its retrieval operators."""
