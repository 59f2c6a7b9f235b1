"""End-to-end jobs that wire the operators together."""
