"""The page pipeline as a stream."""
