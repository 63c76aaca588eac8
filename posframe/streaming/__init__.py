"""Streams: messages handled per batch, keyed tables upserted in order, running state; event-time windows as an extension."""
