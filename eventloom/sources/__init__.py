"""Readers and writers of event logs and of the tables around them."""
