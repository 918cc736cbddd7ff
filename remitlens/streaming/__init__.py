"""Realtime operators. Each transformation also runs on a batch frame."""
