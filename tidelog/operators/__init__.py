"""Operators over key-value logs, snapshots and sorted segments."""
