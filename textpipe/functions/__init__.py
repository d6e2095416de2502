"""Text operations: the executable specification in plain Python, and Catalyst columns."""
