"""Fitted cleaners and models on streaming tables. They hold no state between rows, so the
batch code serves unchanged; there is no streaming operator beyond that."""
