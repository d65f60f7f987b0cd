"""Streams: the interaction log, followed as it grows."""
