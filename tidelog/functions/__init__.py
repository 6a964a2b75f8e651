"""Column functions and codecs: checksum, log records, wire frames, names, return codes."""
