"""Operators over the log and over typed state."""
