"""File drops as a stream."""
