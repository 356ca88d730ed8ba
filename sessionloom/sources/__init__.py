"""Readers of raw payloads and documents, and the event store they end in."""
