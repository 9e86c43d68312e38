"""Training-data operators at corpus scale: each module holds one operator and its registered query."""
