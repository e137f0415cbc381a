"""Streams into panels."""
