"""Readers: messages, lake tables and schedule archives."""
