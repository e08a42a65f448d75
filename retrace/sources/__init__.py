"""Tables of records: reading them by route, and sinks."""
