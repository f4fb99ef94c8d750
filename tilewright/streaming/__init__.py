"""Animation ticks and upload events as streams, each with a batch twin."""
