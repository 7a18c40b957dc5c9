"""Verbs and statistics over views."""
