"""Continuous maintenance of an index from streams."""
