"""The outbox as a stream."""
