"""Content and command safety analytics as Spark DataFrame transforms."""
