"""Change feed over arriving releases."""
