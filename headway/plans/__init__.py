"""Reusable plan shapes: range joins, exact order statistics, gap sessions, table layers."""
