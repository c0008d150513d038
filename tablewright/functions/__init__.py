"""Part of tablewright."""
